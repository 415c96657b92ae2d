"""Quality rules on repetition: text inside duplicated n-grams and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm import batches
from embedlake.llm.words import Texts, Words, mix, not_blank, repeated

SYMBOLS = "#*$%&|<>"
BASE_WINDOW, BASE_WORDS, BASE_SHARE = 5, 10, 20

# Largest share of word characters inside duplicated n-grams, by n, and inside
# lines that repeat an earlier line.
GRAM_SHARES = {5: 0.20, 7: 0.17, 10: 0.14}
LINE_SHARE = 0.30

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, dup_gram_shares array<double>, base_failed boolean, kept boolean"
)


def _covered(words: Words, flags: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Words inside any flagged window."""
    steps = np.zeros(len(words.hashes) + 1, "i8")
    np.add.at(steps, at[flags], 1)
    np.add.at(steps, at[flags] + size, -1)
    return np.cumsum(steps[:-1]) > 0


def _sums(words: Words, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype="i8")])
    return total[words.first[1:]] - total[words.first[:-1]]


def measure(texts: list[bytes], gram_shares: dict[int, float], line_share: float) -> dict[str, np.ndarray]:
    """All measures of a slice of texts, as arrays with one value per text."""
    held = Texts(texts)
    words = Words(held, not_blank(), lower=False)
    starts_point = (held.data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(starts_point & words.inside, dtype="i8")])
    chars = points[words.ends] - points[words.starts]
    word_chars = _sums(words, chars)
    salts = mix(np.arange(held.n, dtype="u8") + np.uint64(1))

    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    out = {
        "n_words": words.counts.astype("i8"),
        "word_chars": word_chars,
        "n_symbols": held.per_text(symbol[held.data]),
    }

    line_bytes = np.ones(256, bool)
    line_bytes[0x0A] = False
    lines = Words(held, line_bytes, lower=False)
    with_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    _, before = repeated(lines.hashes[with_word] ^ salts[lines.text_of[with_word]])
    again = np.zeros(len(lines.hashes), bool)
    again[np.flatnonzero(with_word)[before]] = True
    out["n_dup_lines"] = _sums(lines, again)
    line_chars = _sums(lines, np.where(again, points[lines.ends] - points[lines.starts], 0))
    most = np.maximum(word_chars, 1)
    out["dup_line_share"] = line_chars / most

    text_of, shares = words.text_of, []
    bad = out["dup_line_share"] > line_share
    for size in sorted({BASE_WINDOW, *gram_shares}):
        at, hashes = words.windows(size)
        inside = _covered(words, repeated(hashes ^ salts[text_of[at]])[0], at, size)
        if size == BASE_WINDOW:
            out["n_repeat_words"] = _sums(words, inside)
        if size in gram_shares:
            share = _sums(words, np.where(inside, chars, 0)) / most
            shares.append(share)
            bad |= share > gram_shares[size]
    out["dup_gram_shares"] = np.stack(shares, 1) if shares else np.empty((held.n, 0))
    out["base_failed"] = (out["n_words"] < BASE_WORDS) | (
        100 * out["n_repeat_words"] > BASE_SHARE * out["n_words"]
    )
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def repetition(
    docs: DataFrame,
    gram_shares: dict[int, float] = GRAM_SHARES,
    line_share: float = LINE_SHARE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`doc_id` and the measures of COLUMNS, one row per input row.

    Rolling 64-bit hashes of word windows mark each window that occurs twice or
    more in its own text; shares are characters (code points) of the words it
    covers. A null text has no words, so it fails the base rules, as an empty
    one does. Null and repeated ids are kept as they are. The work is row by
    row: no shuffle, and memory is bounded by a slice of texts.
    """

    def run(parts):
        for part in batches.slices(parts):
            found = measure(batches.raw_texts(part), gram_shares, line_share)
            rows = found.pop("dup_gram_shares")
            arrays = {k: pa.array(v) for k, v in found.items()}
            arrays["dup_gram_shares"] = pa.array(list(rows), pa.list_(pa.float64()))
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[arrays[n] for n in names]], ["doc_id", *names]
            )

    kind = dict(docs.dtypes)[doc_id]
    return batches.take(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def keep_good(
    docs: DataFrame,
    gram_shares: dict[int, float] = GRAM_SHARES,
    line_share: float = LINE_SHARE,
    text: str = "text",
) -> DataFrame:
    """The rows of `docs` whose text passes, with all their columns."""

    def run(parts):
        for part in batches.slices(parts):
            found = measure(batches.raw_texts(part), gram_shares, line_share)
            yield part.select(["row"]).filter(pa.array(found["kept"]))

    rows = docs.select(batches.packed(docs), F.col(text).alias("text"))
    return batches.unpacked(rows.mapInArrow(run, rows.select("row").schema), docs.columns)

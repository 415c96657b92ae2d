"""Packing of documents into windows by non-negative least squares.

Documents are cut into full windows and a remainder. Shallow combinations of
two or three remainder lengths that fill a window exactly are enumerated, and
non-negative least squares finds how often to repeat each so that together
they use up the length histogram. The repeats are rounded down, and what they
leave is packed greedily, longest first. Everything solved on the driver is a
histogram over at most `window` lengths, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlake.llm import batches, encoding
from embedlake.session import cut_lineage

WINDOW, END_ID = 2048, 1
# Pieces of one length that one task may number.
CELL = 1 << 16


def combinations(window: int) -> np.ndarray:
    """All ascending pairs and triples of lengths that fill a window; 0 pads a pair."""
    half = np.arange(1, window // 2 + 1)
    rows = [np.stack([np.zeros_like(half), half, window - half], 1)]
    for a in range(1, window // 3 + 1):
        b = np.arange(a, (window - a) // 2 + 1)
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(rows)


def _descend(combos: np.ndarray, counts: np.ndarray, x: np.ndarray, rounds: int) -> np.ndarray:
    """Accelerated projected gradient for min |A x - counts|, x >= 0."""
    size = len(counts)
    uses = np.bincount(combos.ravel(), minlength=size)
    uses[0] = 0
    step = 1.0 / max(1.0, 3.0 * uses.max())
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        made = np.bincount(combos.ravel(), np.repeat(y, 3), size)
        gap = counts - made
        gap[0] = 0
        new = np.maximum(0, y + step * gap[combos].sum(1))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = np.maximum(0, new + (last - 1) / t * (new - x))
        x = new
    return x


def solve(counts: np.ndarray, window: int, stages: int = 5, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often to repeat them, before rounding.

    Combinations enter in stages: those that the unmet counts of some length
    pull in most, so the answer stays sparse and survives rounding down.
    """
    every = combinations(window)
    goal = counts.astype(float)
    chosen, x = np.flatnonzero(every[:, 0] == 0), None
    x = np.zeros(len(chosen))
    for stage in range(stages):
        x = _descend(every[chosen], goal, x, rounds)
        if stage == stages - 1:
            break
        made = np.bincount(every[chosen].ravel(), np.repeat(x, 3), len(goal))
        gap = goal - made
        gap[0] = 0
        pull = gap[every].sum(1)
        pull[chosen] = 0
        best = np.flatnonzero(pull > 0.5)
        # The strongest combination of each length, seen from its largest part.
        best = best[np.argsort(-pull[best], kind="stable")]
        _, first = np.unique(every[best, 2], return_index=True)
        _, second = np.unique(every[best, 1], return_index=True)
        new = best[np.unique(np.concatenate([first, second]))] if len(best) else best
        keep = x > 1e-3
        chosen, x = np.concatenate([chosen[keep], new]), np.concatenate([x[keep], np.zeros(len(new))])
        chosen, order = np.unique(chosen, return_index=True)
        x = x[order]
    return every[chosen], x


@dataclass
class Plan:
    """Where the pieces of each length go, by their number within the length.

    Pieces `begin` up to `begin + total` of `length` sit `per` by `per` in
    sequences from `base` on, the first of them at `offset`.
    """

    length: np.ndarray
    begin: np.ndarray
    per: np.ndarray
    base: np.ndarray
    offset: np.ndarray

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(self.length, lengths, "left")
        at, high = first, np.searchsorted(self.length, lengths, "right")
        # Last row of the length that begins at or before the number.
        while (high - at > 1).any():
            middle = (at + high) // 2
            left = self.begin[np.minimum(middle, len(self.begin) - 1)] <= numbers
            wide = high - at > 1
            at, high = np.where(wide & left, middle, at), np.where(wide & ~left, middle, high)
        q = numbers - self.begin[at]
        return self.base[at] + q // self.per[at], self.offset[at] + q % self.per[at] * lengths


def plan(counts: np.ndarray, window: int) -> Plan:
    """Pack `counts[length]` pieces of every length up to `window`."""
    left = counts.astype("i8").copy()
    patterns: list[tuple[int, list[tuple[int, int]]]] = []
    if left[window]:
        patterns.append((int(left[window]), [(window, 1)]))
        left[window] = 0
    if left.sum():
        combos, x = solve(left[:window], window)
        for j in np.argsort(-x, kind="stable"):
            parts, uses = np.unique(combos[j][combos[j] > 0], return_counts=True)
            times = min(int(x[j]), *(int(left[p]) // int(u) for p, u in zip(parts, uses)))
            if times > 0:
                left[parts] -= times * uses
                patterns.append((times, [(int(p), int(u)) for p, u in zip(parts, uses)][::-1]))
    present = [int(p) for p in np.flatnonzero(left)]
    while present:
        runs, room, at = [], window, len(present) - 1
        while room and at >= 0:
            at = min(at, int(np.searchsorted(present, room, "right")) - 1)
            if at < 0:
                break
            part = present[at]
            uses = min(room // part, int(left[part]))
            runs.append((part, uses))
            room -= uses * part
            at -= 1
        times = min(int(left[p]) // u for p, u in runs)
        for p, u in runs:
            left[p] -= times * u
        patterns.append((times, runs))
        present = [p for p in present if left[p]]
    rows, base, used = [], 0, np.zeros(window + 1, "i8")
    for times, runs in patterns:
        offset = 0
        for part, uses in runs:
            rows.append((part, int(used[part]), uses, base, offset))
            used[part] += times * uses
            offset += uses * part
        base += times
    table = np.array(sorted(rows), "i8").reshape(-1, 5)
    return Plan(*table.T)


def pieces(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """`doc_id, start, length, ids_crc32, doc_tokens` of full windows and remainders."""

    def run(parts):
        encode = encoding.encoder(tokenizer)
        end, step = END_ID.to_bytes(4, "little"), 4 * window
        for part in batches.slices(parts):
            keys = part.column("doc_id").to_pylist()
            rows = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for key, found in zip(keys, encode.encode_all(batches.texts(part))):
                ids = memoryview(found + end)
                for at in range(0, len(ids), step):
                    own = ids[at : at + step]
                    for name, value in zip(rows, (key, at // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4)):
                        rows[name].append(value)
            arrays = [pa.array(rows["doc_id"], part.schema.field("doc_id").type)]
            arrays += [pa.array(rows[n], "int64") for n in list(rows)[1:]]
            yield pa.RecordBatch.from_arrays(arrays, list(rows))

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def numbered(rows: DataFrame, sizes: dict[int, int], cell: int = CELL) -> DataFrame:
    """Number the pieces of each length from 0 in column `number`.

    A length with more than `cell` pieces is numbered in several cells, so one
    length may hold a third of all pieces. Equal rows may swap numbers.
    """
    session = rows.sparkSession
    cells = session.createDataFrame([(k, -(-n // cell)) for k, n in sizes.items()], "length long, cells long")
    keyed = rows.join(cells, "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "start"), F.col("cells"))).drop("cells")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("length", "cell").agg(F.count("*").alias("n")).select(
        "length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "start")
    counted = keyed.withColumn("place", F.row_number().over(inside) - 1)
    return counted.join(totals, ["length", "cell"]).withColumn("number", F.col("first") + F.col("place")).drop(
        "first", "place", "cell"
    )


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", cell: int = CELL
) -> DataFrame:
    """`doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`, one row per piece.

    A document is its ids and the end id; a null text is empty and is the end
    id alone. Repeated rows are packed as often as they occur, null ids too. An
    empty table gives no rows. Sequences are numbered from 0 without gaps, and
    no sequence exceeds `window`.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = cut_lineage(pieces(rows, tokenizer, window))
    # At most `window` rows.
    sizes = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(window + 1, "i8")
    for length, n in sizes.items():
        counts[length] = n
    layout = docs.sparkSession.sparkContext.broadcast(plan(counts, window))

    def run(parts):
        for part in parts:
            if part.num_rows:
                length, number = (part.column(c).to_numpy() for c in ("length", "number"))
                sequence, offset = layout.value.place(length, number)
                names = [n for n in part.schema.names if n != "number"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                    [*names, "sequence_id", "offset"],
                )

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kinds = dict(held.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return numbered(held, sizes, cell).select(*columns, "number").mapInArrow(run, schema)

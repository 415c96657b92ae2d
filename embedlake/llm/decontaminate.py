"""Benchmark decontamination by a prefix-filtered set join on word shingles.

A window is `window` consecutive words of an item (a shorter item is one
window) and is seen as the set of its shingles. A document contains a window
only if it contains all its shingles, so with shingles ordered by rarity in the
corpus the necessary prefix is the rarest one: only places of that shingle are
joined. A window one of whose shingles never occurs is out at once. Position
and length bounds and a comparison of all words follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm import batches
from embedlake.llm.words import Texts, Words, alphanumeric, mix
from embedlake.session import cut_lineage

SHINGLE = 5
# Bits of the filter that the tasks get: fixed, whatever the benchmark holds.
# Shingles of a larger benchmark pass it more often; the join then drops them.
FILTER_BITS = 1 << 24


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, hashes = words.windows(size)
    return at, mix(hashes + np.uint64(size)).view("i8")


def windows(items: DataFrame, window: int, shingle: int, item_id: str, text: str) -> DataFrame:
    """`item_id, words, length, shingles` of all windows of all items."""

    def run(parts):
        for part in batches.slices(parts):
            words = Words(Texts(batches.raw_texts(part)), alphanumeric(), lower=True)
            rows = {"item_id": [], "words": [], "length": [], "shingles": []}
            for i, key in enumerate(part.column("item_id").to_pylist()):
                a, b = int(words.first[i]), int(words.first[i + 1])
                size = min(window, b - a)
                for at in range(a, b - size + 1) if size else ():
                    rows["item_id"].append(key)
                    rows["words"].append(words.words(at, at + size))
                    rows["length"].append(size)
                    rows["shingles"].append(at)
            by_size = {}
            for n in set(rows["length"]):
                k = min(n, shingle)
                starts, hashes = _shingles(words, k)
                by_size[n] = (np.searchsorted(starts, np.arange(len(words.hashes) + 1)), hashes, n - k + 1)
            rows["shingles"] = [
                by_size[n][1][by_size[n][0][at] : by_size[n][0][at] + by_size[n][2]].tolist()
                for at, n in zip(rows["shingles"], rows["length"])
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": pa.array(rows["item_id"], part.schema.field("item_id").type),
                    "words": pa.array(rows["words"], "string"),
                    "length": pa.array(rows["length"], "int32"),
                    "shingles": pa.array(rows["shingles"], pa.list_(pa.int64())),
                }
            )

    rows = batches.take(items, item_id=item_id, text=text).where("item_id is not null")
    kind = dict(items.dtypes)[item_id]
    return rows.mapInArrow(run, f"item_id {kind}, words string, length int, shingles array<bigint>")


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap over hash values; at most bits / 64 rows come to the driver."""
    place = F.pmod("shingle", F.lit(bits))
    rows = (
        hashes.select((place / 64).cast("int").alias("word"), F.expr(f"1L << cast(pmod(shingle, 64) as int)").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .collect()
    )
    out = np.zeros(bits // 64, "<i8")
    for row in rows:
        out[row["word"]] = row["bit"]
    return np.unpackbits(out.view("u1"), bitorder="little").view(bool)


def _counts(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """How often each shingle that passes the filter occurs in the documents."""
    bits = len(wanted)
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(parts):
        passes = np.unpackbits(packed.value).view(bool)
        for part in batches.slices(parts):
            words = Words(Texts(batches.raw_texts(part)), alphanumeric(), lower=True)
            for size in sizes:
                _, hashes = _shingles(words, size)
                found, counts = np.unique(hashes[passes[hashes % bits]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, wanted: np.ndarray, sizes: list[int], window: int, shingle: int) -> DataFrame:
    """Documents with the places of prefix shingles and the words around them."""
    bits = len(wanted)
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    place = pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("begin", pa.int64()), ("around", pa.string())])

    def run(parts):
        passes = np.unpackbits(packed.value).view(bool)
        for part in batches.slices(parts):
            words = Words(Texts(batches.raw_texts(part)), alphanumeric(), lower=True)
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for size in sizes:
                at, hashes = _shingles(words, size)
                hit = passes[hashes % bits]
                for a, h in zip(at[hit].tolist(), hashes[hit].tolist()):
                    doc = int(np.searchsorted(words.first, a, "right")) - 1
                    first, last = int(words.first[doc]), int(words.first[doc + 1])
                    reach = window - size if size == shingle else 0
                    low, high = max(first, a - reach), min(last, a + size + reach)
                    found[doc].append(
                        {"shingle": h, "at": a - first, "begin": low - first, "around": words.words(low, high)}
                    )
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "print_a", "print_b")), pa.array(words.counts, "int64"),
                 pa.array(found, pa.list_(place))],
                ["doc_id", "print_a", "print_b", "n_words", "places"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(
        run,
        f"doc_id {kind}, print_a long, print_b long, n_words long, "
        "places array<struct<shingle:bigint,at:bigint,begin:bigint,around:string>>",
    )


def _printed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and two fingerprints of the text that tell rows apart."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print_a"),
        F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit(""))).alias("print_b"),
    )


def judge(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = SHINGLE,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """`doc_id, print_a, print_b, n_words, n_hit, items, contaminated`, one row per input row.

    `n_hit`: words inside any occurrence of a window; `items`: ids whose
    windows occur, as strings in string order. Words are alphanumeric, A-Z in
    lower case. Null and empty texts have no words and no windows; items with a
    null id are left out, items with equal ids are one. Rows with equal doc_id
    and text have equal results; a null doc_id is kept. Empty tables give no
    hits. Only places of prefix shingles are shuffled.
    """
    printed = _printed(docs, doc_id, text)
    held = cut_lineage(windows(items, window, shingle, item_id, item_text))
    sizes = sorted({min(r["length"], shingle) for r in held.select("length").distinct().collect()})
    every = held.select(F.explode("shingles").alias("shingle")).distinct()
    counts = _counts(printed, _filter(every, FILTER_BITS), sizes)

    # The rarest shingle of each distinct window, ties by hash; a shingle the
    # corpus lacks has no count, and its windows drop out.
    uses = held.select("words", "length", F.posexplode("shingles").alias("offset", "shingle")).distinct()
    counted = uses.join(counts, "shingle", "left")
    prefix = (
        counted.groupBy("words", "length")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"),
        )
        .where("rarest.n > 0")
        .select("words", "length", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"))
    )
    owners = held.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("owners"))
    prefix = cut_lineage(prefix.join(owners, "words"))

    found = _places(printed, _filter(prefix.select("shingle"), FILTER_BITS), sizes, window, shingle)
    marker = F.struct(
        F.col("print_a").alias("shingle"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("begin"),
        F.lit("").alias("around"),
    )
    # One marker per row keeps rows without places and counts repeated rows.
    keys = ["doc_id", "print_a", "print_b", "n_words"]
    rows = found.select(*keys, F.explode(F.concat("places", F.array(marker))).alias("p")).select(*keys, "p.*")
    joined = rows.join(prefix, "shingle", "left")
    start = F.col("at") - F.col("offset")
    inside = (F.col("at") >= 0) & (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = (
        F.array_join(F.slice(F.split("around", " "), (start - F.col("begin") + 1).cast("int"), F.col("length")), " ")
        == F.col("words")
    )
    # The slice is only taken inside the bounds.
    hit = F.when(inside, F.when(start >= F.col("begin"), same).otherwise(False)).otherwise(False)
    checked = joined.withColumn("hit", F.coalesce(hit, F.lit(False)))
    marked = F.col("at") < 0
    # A marker meets prefix rows only by a hash collision; it then counts once.
    grouped = checked.groupBy(*keys).agg(
        F.count(F.when(marked & F.coalesce(F.col("offset") == 0, F.lit(True)), 1)).alias("copies"),
        F.collect_set(F.when(F.col("hit"), F.struct(start.alias("begin"), (start + F.col("length")).alias("end")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.col("owners"))))).alias("items"),
    )
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        F.array_sort("spans"),
        nothing,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["begin"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    out = grouped.select(*keys, covered.alias("n_hit"), F.array_sort("items").alias("items"), "copies")
    return out.select(
        *keys, "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))).alias("copy"),
    ).drop("copy")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, **names: str) -> DataFrame:
    """The rows of `docs` without any window of an item, all columns kept."""
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    bad = judge(docs, items, window, **names).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("print_a").alias("bad_a"), F.col("print_b").alias("bad_b"))
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        batches.packed(docs),
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(filled).alias("print_a"),
        F.xxhash64(F.lit(1), filled).alias("print_b"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & F.expr("print_a = bad_a and print_b = bad_b")
    return batches.unpacked(rows.join(bad.distinct(), same, "left_anti"), docs.columns)

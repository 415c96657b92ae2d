"""Exact histogram of encoded lengths, and what it answers by suffix sums."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedlake.llm import batches, encoding
from embedlake.session import cut_lineage

BLOCK = 1024


def length_counts(docs: DataFrame, tokenizer: str, text: str = "text", end: bool = False) -> DataFrame:
    """`n_tokens, n_docs`: how many documents encode to each length.

    Every row of `docs` counts once, repeated rows and null ids included. A
    null text is empty; an empty text has length 0 (1 with `end`, which adds
    the end id). No documents give no rows. Other columns are not read.
    """

    def count(parts):
        encode = encoding.encoder(tokenizer)
        for part in batches.slices(parts):
            seen = Counter(len(ids) // 4 + end for ids in encode.encode_all(batches.texts(part)))
            yield pa.RecordBatch.from_pydict(
                {"n_tokens": pa.array(seen.keys(), "int64"), "n_docs": pa.array(seen.values(), "int64")}
            )

    found = batches.take(docs, text=text).mapInArrow(count, "n_tokens long, n_docs long")
    # The small result is kept, so that the texts are encoded once.
    return cut_lineage(found.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def histogram(counts: DataFrame) -> DataFrame:
    """Add running sums from either end to `n_tokens, n_docs`.

    `docs_from`, `tokens_from`: documents of at least this length and their
    tokens; `docs_upto`: documents of at most this length; `truncated_total`:
    tokens left when every document is cut to this length. Sums run inside
    blocks of 1,024 lengths and over block totals, so no task sees all lengths.
    """
    rows = counts.select(
        "n_tokens",
        "n_docs",
        (F.col("n_tokens") * F.col("n_docs")).alias("total_tokens"),
        F.floor(F.col("n_tokens") / BLOCK).cast("long").alias("block"),
    )
    totals = rows.groupBy("block").agg(
        F.sum("n_docs").alias("block_docs"), F.sum("total_tokens").alias("block_tokens")
    )
    # One row per 1,024 token lengths: the longest document bounds it.
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        F.col("block"),
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    joined = rows.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        "total_tokens",
        (F.col("later_docs") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("later_tokens") + F.sum("total_tokens").over(inside)).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )
    return joined.select(
        "n_tokens",
        "n_docs",
        "total_tokens",
        "docs_from",
        "tokens_from",
        (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias(
            "truncated_total"
        ),
    )


def truncated_totals(counts: DataFrame, limits: list[int]) -> DataFrame:
    """`context_limit, kept_tokens, cut_docs` for any context limits."""
    wanted = F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context_limit")
    rows = counts.select("*", wanted)
    return rows.groupBy("context_limit").agg(
        F.sum(F.least("n_tokens", F.col("context_limit").cast("long")) * F.col("n_docs")).alias("kept_tokens"),
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("cut_docs"),
    )


def quantiles(summed: DataFrame, shares: list[float]) -> DataFrame:
    """`share, n_tokens`: the smallest length that holds this share of documents."""
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    rows = summed.select("*", wanted, (F.col("docs_upto") + F.col("docs_from") - F.col("n_docs")).alias("n"))
    return (
        rows.where(F.col("docs_upto") >= F.greatest(F.col("share") * F.col("n"), F.lit(1.0)))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )

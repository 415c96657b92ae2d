"""Labelled pairs, splits, batches and statistics for embedding training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.operators.canonical import ROLES, WHITE_SPACE, valid_triplet
from embedlake.operators.ranking import row_position
from embedlake.session import cut_lineage

VALIDATION_SHARE = 0.1
EDGE_SPACE = f"\\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\\z"


def usable_triplets(triplets: DataFrame) -> DataFrame:
    """Trimmed triplets without blanks."""
    trimmed = triplets.withColumns(
        {r: F.regexp_replace(F.col(r).cast("string"), EDGE_SPACE, "") for r in ROLES}
    )
    return trimmed.filter(valid_triplet())


def training_examples(triplets: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(question, positive, +1) and (question, negative, -1) per usable triplet."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(slot).alias("slot"),
                F.col("question").alias("text_a"),
                F.col(role).alias("text_b"),
                F.lit(label).alias("label"),
            )
            for slot, (role, label) in enumerate([("positive", 1.0), ("negative", -1.0)])
        ]
    )
    return usable_triplets(triplets).select(*keep, F.inline(pairs))


def mark_last_as_validation(df: DataFrame, dataset: str, last: Column) -> DataFrame:
    """All datasets train, the last one of the list validates."""
    role = F.when(F.col(dataset) == last, F.lit("validation")).otherwise(F.lit("train"))
    return df.withColumn("role", role)


def split_by_position(
    keys: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    levels: Sequence[Column],
    share: float = VALIDATION_SHARE,
    rows_per_key: int = 2,
) -> DataFrame:
    """Leading ``int(share * examples)`` examples of each dataset validate.

    ``keys`` holds one narrow row per usable triplet; the two examples of a
    triplet take neighbouring positions, so a cut may separate them.
    """
    by = list(by)
    # The keys are read three times; whatever selects them runs once.
    keys = cut_lineage(keys)
    placed = row_position(keys, order, levels, by, name="__triplet")
    sizes = keys.groupBy(*by).agg((F.count("*") * rows_per_key).alias("n_examples"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(rows_per_key - 1)))
    return (
        placed.join(sizes, by)
        .withColumn("slot", slots)
        .withColumn("position", F.col("__triplet") * rows_per_key + F.col("slot"))
        .withColumn(
            "split",
            F.when(
                F.col("position") < F.floor(F.lit(share) * F.col("n_examples")),
                F.lit("validation"),
            ).otherwise(F.lit("train")),
        )
        .drop("__triplet")
    )


def hash_split(df: DataFrame, key: Sequence[str], share: float = VALIDATION_SHARE) -> DataFrame:
    """Shuffle-free split: a stable hash of the key decides, whole triplets move."""
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.withColumn(
        "split",
        F.when(place < round(share * 16**8), F.lit("validation")).otherwise(F.lit("train")),
    )


def with_batches(df: DataFrame, batch_size: int, position: str = "position") -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col(position) / batch_size))


def training_stats(triplets: DataFrame, dataset: str, share: float = VALIDATION_SHARE) -> DataFrame:
    """Samples, examples and split sizes of each dataset."""
    trimmed_ok = valid_triplet()
    examples = F.col("total_examples")
    return (
        triplets.groupBy(dataset)
        .agg(
            F.count("*").alias("total_samples"),
            (F.count_if(trimmed_ok) * 2).alias("total_examples"),
        )
        .withColumn("validation_examples", F.floor(F.lit(share) * examples))
        .withColumn("train_examples", examples - F.col("validation_examples"))
    )


def throughput(runs: DataFrame) -> DataFrame:
    """Rates of runs with ``n_samples, runtime_s, batch_size, epochs``."""
    steps = F.ceil(F.col("n_samples") / F.col("batch_size")) * F.col("epochs")
    per_second = lambda n: F.when(
        F.col("runtime_s") > 0, n / F.col("runtime_s")
    ).otherwise(F.lit(0.0))
    return (
        runs.withColumn("total_steps", steps)
        .withColumn("train_samples_per_second", per_second(F.col("n_samples")))
        .withColumn("train_steps_per_second", per_second(F.col("total_steps")))
    )

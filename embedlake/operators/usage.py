"""Daily usage counts with gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_counts(usage: DataFrame, model: str = "ai_model_id", ts: str = "created_at") -> DataFrame:
    """Usage rows per model and UTC day."""
    return usage.groupBy(model, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def usage_by_tag(
    wanted: DataFrame,
    models: DataFrame,
    usage: DataFrame,
    tag: str = "model_tag",
    key: str = "id",
    model: str = "ai_model_id",
    ts: str = "created_at",
) -> DataFrame:
    """Daily counts of the models with the wanted tags, and whether a tag exists.

    A tag of no model has ``found`` false and null day and count; a model that
    was never used has a null day and the count 0. Usage is counted per model
    and day before it meets the tags.
    """
    counts = daily_counts(usage, model, ts).withColumnRenamed(model, key)
    known = models.select(key, tag, F.lit(True).alias("found"))
    tagged = wanted.select(tag).distinct().join(known, tag, "left")
    joined = tagged.join(counts, key, "left").groupBy(tag, "found", "day").agg(F.sum("n").alias("n"))
    found = F.coalesce("found", F.lit(False))
    return joined.select(
        tag, found.alias("found"), "day", F.when(found, F.coalesce("n", F.lit(0))).alias("n")
    )


def daily_usage(
    models: DataFrame, usage: DataFrame, today: Column, model: str = "ai_model_id"
) -> DataFrame:
    """One row per model and day from its creation to ``today``, zeros included.

    ``models`` has the model key and ``created_at``.
    """
    days = F.sequence(F.to_date("created_at"), today, F.expr("interval 1 day"))
    started = models.filter(F.to_date("created_at") <= today)
    spine = started.select(model, F.explode(days).alias("day"))
    return spine.join(daily_counts(usage, model), [model, "day"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )

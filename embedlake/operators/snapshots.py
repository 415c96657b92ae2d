"""Stored registry tables whose updates rewrite only what they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.operators.registry import OUTCOME_APPLIED, OUTCOME_MISSING, OUTCOME_STALE, optimistic_update
from embedlake.session import cut_lineage

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Store a table in buckets by the hash of its key.

    Deleted rows stay as marks, so a bucket that lost all its rows is written
    like any other; `path/meta` keeps the number of buckets.
    """
    spark = rows.sparkSession
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/meta")
    held = rows.withColumns({"__live": F.lit(True), "__bucket": _bucket(key, buckets)})
    if rows.isEmpty():
        # A folder without files has no columns.
        held.drop("__bucket").write.parquet(f"{path}/rows/__bucket=0")
    else:
        _put(held, path)


def _put(rows: DataFrame, path: str) -> None:
    # A file per bucket; dynamic overwrite leaves every other bucket alone, and
    # moves the new files in when all of them are written.
    rows.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "__bucket"
    ).parquet(f"{path}/rows")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table that are not deleted."""
    return _stored(spark, path).where("__live").drop("__live", "__bucket")


def _touched(spark: SparkSession, path: str, changes: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rows of the buckets that changes fall into; at most one number per bucket comes back."""
    buckets = spark.read.parquet(f"{path}/meta").first()[0]
    hit = [r[0] for r in changes.select(_bucket(key, buckets)).distinct().collect()]
    return _stored(spark, path).where(F.col("__bucket").isin(hit)), buckets


def update(
    spark: SparkSession, path: str, updates: DataFrame, fields: Sequence[str], key: str = "id", version: str = "version",
    expected: str = "expected_version", sequence: str = "seq", chained: bool = True,
) -> DataFrame:
    """Apply versioned updates to a stored table; returns the outcome of each.

    The rules are those of `optimistic_update`; deleted rows are not found. Only
    buckets with an update are read and written. Outcomes are fixed before the
    rows change, so they can be read after it.
    """
    held, buckets = _touched(spark, path, updates, key)
    live = held.where("__live").drop("__live", "__bucket")
    outcomes, after = optimistic_update(live, updates, fields, key, version, expected, sequence, chained)
    outcomes = cut_lineage(outcomes)
    marks = held.where("NOT __live")
    now = after.withColumns({"__live": F.lit(True), "__bucket": _bucket(key, buckets)})
    _put(now.unionByName(marks), path)
    return outcomes


def delete(spark: SparkSession, path: str, deleted: DataFrame, key: str = "id", version: str | None = None, expected: str = "expected_version") -> DataFrame:
    """Delete rows by key, with `version` only those of the expected one; returns `key, outcome`."""
    held, _ = _touched(spark, path, deleted, key)
    ids = deleted.groupBy(key).agg(F.max(expected).alias("__expected")) if version else deleted.select(key).distinct()
    live = held.where("__live")
    right = F.col(version) == F.col("__expected") if version else F.lit(True)
    known = live.select(key, *([version] if version else []), F.lit(True).alias("__known"))
    told = ids.join(known, key, "left").select(
        key,
        F.when(F.col("__known").isNull(), F.lit(OUTCOME_MISSING))
        .when(right, F.lit(OUTCOME_APPLIED))
        .otherwise(F.lit(OUTCOME_STALE))
        .alias("outcome"),
    )
    told = cut_lineage(told)
    gone = told.where(F.col("outcome") == OUTCOME_APPLIED).select(key, F.lit(True).alias("__gone"))
    now = held.join(gone, key, "left").withColumn("__live", F.col("__live") & F.col("__gone").isNull()).drop("__gone")
    _put(now, path)
    return told

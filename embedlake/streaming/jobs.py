"""Streaming forms of the monitoring, usage and task operators.

Each takes a streaming frame and returns one to be written in update mode.
``lateness`` bounds the state of a live stream; replays of stored files pass
None, because files may come in any order and no row may be dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.operators import tasks as tk

LATENESS = "10 minutes"


def _bounded(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, lateness) if lateness else df


def request_rate(
    requests: DataFrame,
    width: str = "5 minutes",
    slide: str = "1 minute",
    lateness: str | None = LATENESS,
) -> DataFrame:
    """Requests per sliding window and path."""
    # Grouping by the whole window keeps its event time, so old state goes.
    return (
        _bounded(requests, "ts", lateness)
        .groupBy(F.window("ts", width, slide).alias("w"), "path")
        .agg(F.count("*").alias("n_requests"))
        .select(F.col("w.start").alias("window_start"), "path", "n_requests")
    )


def daily_usage(usage: DataFrame, lateness: str | None = "1 day") -> DataFrame:
    """Usage rows per model and day."""
    return (
        _bounded(usage, "created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("w"), "ai_model_id")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("day"), "ai_model_id", "n")
    )


LOG_SCHEMA = "message string, time string, level string"
# Labels every parsed line gets.
LOG_LABELS = {"application": "fastapi", "source": "fastapi"}


def parse_logs(lines: DataFrame, received: Column | None = None) -> DataFrame:
    """JSON log lines: event time, fixed labels, message as the output.

    A line whose time does not parse keeps the time it was received.
    """
    record = F.from_json("value", LOG_SCHEMA)
    parsed = F.try_to_timestamp(F.col("record.time"))
    return lines.withColumn("record", record).select(
        *[c for c in lines.columns if c != "value"],
        F.coalesce(parsed, received if received is not None else F.current_timestamp()).alias("ts"),
        *[F.lit(value).alias(label) for label, value in LOG_LABELS.items()],
        F.coalesce("record.message", "value").alias("message"),
    )


def task_states(log: DataFrame, rule: str = tk.RUN_RULE) -> DataFrame:
    """Current state of each task; state is one row per task."""
    return tk.task_states(log, rule, order=["ts", "event_id"], kept_fields=["progress"])


def in_flight_at(requests: DataFrame, at: Column) -> DataFrame:
    """Open requests per method and path at one instant."""
    end = F.col("ts") + F.make_dt_interval(secs=F.col("duration_s").cast("decimal(18,6)"))
    open_now = (F.col("ts") <= at) & (end > at)
    return requests.groupBy("method", "path").agg(F.count_if(open_now).alias("in_flight"))

"""Streams over the event file, each with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.operators import tasks as tk
from embedlake.plans.catalog import query
from embedlake.plans.monitoring import REQUESTS_SQL
from embedlake.plans.tables import Tables, requests, task_log
from embedlake.plans.tasks import LOG_SQL, _state_sql
from embedlake.streaming import jobs, state
from embedlake.streaming.changelog import read_stream, replay, replay_appends, replay_closed


class StreamedTables(Tables):
    """The same derivations, reading each table as a stream."""

    def __getattr__(self, name: str) -> DataFrame:
        return read_stream(self.spark, f"{self.folder}/{name}.parquet")


def streamed(t: Tables) -> StreamedTables:
    return StreamedTables(t.spark, t.folder)


@query(
    f"""WITH {REQUESTS_SQL}
SELECT date_trunc('minute', ts) - to_minutes(k) AS window_start, path, count(*) AS n_requests
FROM requests, range(5) r(k) GROUP BY 1, 2"""
)
def stream_request_rate(t: Tables) -> DataFrame:
    counts = jobs.request_rate(requests(streamed(t)), lateness=None)
    final = replay(counts, ["window_start", "path"], "request-rate")
    return final.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT ts::DATE AS day, user_id AS ai_model_id, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_usage(t: Tables) -> DataFrame:
    usage = streamed(t).events.select(
        F.col("user_id").alias("ai_model_id"), F.col("ts").alias("created_at")
    )
    final = replay(jobs.daily_usage(usage, lateness=None), ["day", "ai_model_id"], "daily-usage")
    return final.withColumn("day", F.to_date("day"))


@query(
    """SELECT event_id, ts, 'fastapi' AS application, 'fastapi' AS source,
  event_type || ' by ' || user_id AS message FROM events"""
)
def stream_log_parse(t: Tables) -> DataFrame:
    """Events written as JSON log lines, then parsed."""
    record = F.struct(
        F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("message"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("time"),
        F.lit("INFO").alias("level"),
    )
    lines = streamed(t).events.select("event_id", F.to_json(record).alias("value"))
    parsed = replay_appends(jobs.parse_logs(lines), "log-parse")
    return parsed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {LOG_SQL} {_state_sql('run')}".replace("'run' AS rule, ", ""))
def stream_task_state(t: Tables) -> DataFrame:
    states = jobs.task_states(task_log(streamed(t)), tk.RUN_RULE)
    return replay(states, ["id"], "task-state")


@query(
    f"""WITH {REQUESTS_SQL}
SELECT method, path, count(*) FILTER (ts <= TIMESTAMP '2024-01-15'
  AND ts + to_microseconds(round(duration_s * 1000000)::BIGINT) > TIMESTAMP '2024-01-15') AS in_flight
FROM requests GROUP BY method, path"""
)
def stream_in_flight(t: Tables) -> DataFrame:
    at = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    return replay(jobs.in_flight_at(requests(streamed(t)), at), ["method", "path"], "in-flight")


# Stored files come in any order, so no row of them may count as late.
WHOLE_SPAN = "366 days"
MILLENNIA = 2_000 * 366 * 86_400_000


def _closing(rows: DataFrame, **values) -> DataFrame:
    """One row of the same columns, far behind all others."""
    names = {c: F.lit(values.get(c)).cast(kind) for c, kind in rows.dtypes}
    late = F.lit("2200-01-01 00:00:00").cast(dict(rows.dtypes)["ts"])
    return rows.sparkSession.range(1).select(*[(late if c == "ts" else v).alias(c) for c, v in names.items()])


@query(
    f"""WITH {REQUESTS_SQL}, steps AS (
  SELECT method, path, ts AS instant, 1 AS change FROM requests
  UNION ALL SELECT method, path, ts + to_microseconds(round(duration_s * 1000000)::BIGINT), -1 FROM requests),
summed AS (SELECT method, path, instant, sum(change) AS change FROM steps GROUP BY ALL)
SELECT method, path, instant, (sum(change) OVER (PARTITION BY method, path ORDER BY instant))::BIGINT AS in_flight
FROM summed"""
)
def stream_gauge(t: Tables) -> DataFrame:
    """The running gauge; every seventh request comes a second time."""
    rows = requests(t).select("event_id", "method", "path", "ts", "duration_s")
    sent = rows.unionByName(rows.filter("event_id % 7 = 0"))
    build = lambda stream: state.running_gauge(stream, lateness=WHOLE_SPAN)
    closing = _closing(rows, event_id=-1, method="end", path="end", duration_s=0)
    found = replay_closed(sent, closing, build, ["method", "path", "instant"], "gauge", "append")
    return found.withColumn("instant", F.col("instant").cast("timestamp_ntz"))


@query(
    f"""WITH {LOG_SQL}, placed AS (
  SELECT *, coalesce(sum((task_status IN ('D', 'F'))::INT) OVER (
    PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM log)
SELECT id, arg_max(task_status, (ts, event_id)) FILTER (ended = 0) AS task_status,
  max(ts) FILTER (ended = 0 AND task_status IN ('D', 'F')) AS end_date,
  arg_max(error_msg, (ts, event_id)) FILTER (ended = 0 AND error_msg IS NOT NULL) AS error_msg,
  arg_max(progress, (ts, event_id)) FILTER (ended = 0 AND progress IS NOT NULL) AS progress,
  count(*) FILTER (ended > 0) AS refused
FROM placed GROUP BY id"""
)
def stream_task_life(t: Tables) -> DataFrame:
    """Tasks that end once; the events of a file are in no order."""
    log = task_log(t).orderBy(F.xxhash64("event_id"))
    closing = _closing(task_log(t), id=-1, event_id=-1, task_status="Q")
    build = lambda stream: state.task_life(stream, lateness=WHOLE_SPAN, retention_ms=MILLENNIA)
    found = replay_closed(log, closing, build, ["id"], "task-life").filter("id <> -1")
    return found.withColumn("end_date", F.col("end_date").cast("timestamp_ntz"))

"""Monitoring queries over the request table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.operators import monitoring as mo
from embedlake.plans.catalog import query
from embedlake.plans.tables import Tables, now, requests

REQUESTS_SQL = """
requests AS (
  SELECT event_id, ts, 'job' || user_id % 5 AS job,
    CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
    '/' || event_type || '/' || user_id % 7 AS path,
    CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 10 = 0 THEN 301
         WHEN event_id % 10 = 1 THEN 404 ELSE 200 END AS status,
    value AS duration_s FROM events)"""

_MINUTE = "date_trunc('minute', ts) AS window_start"
_FIVE = "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2024-01-01') AS window_start"


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return _naive(df).withColumns({n: F.round(n, 6) for n in names})


@query(
    f"WITH {REQUESTS_SQL} SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_requests "
    "FROM requests GROUP BY 1"
)
def requests_hourly(t: Tables) -> DataFrame:
    return _naive(mo.requests_per(requests(t), "1 hour"))


@query(
    f"WITH {REQUESTS_SQL} SELECT {_MINUTE}, round(count(*) / 60.0::DOUBLE, 6) AS req_per_s "
    "FROM requests GROUP BY 1"
)
def request_rate(t: Tables) -> DataFrame:
    return _rounded(mo.request_rate(requests(t)), "req_per_s")


_CLASSES_SQL = ", ".join(
    f"round(count(*) FILTER (status // 100 = {c}) / 60.0::DOUBLE, 6) AS rate_{c}xx" for c in (2, 3, 4, 5)
)


@query(f"WITH {REQUESTS_SQL} SELECT {_MINUTE}, {_CLASSES_SQL} FROM requests GROUP BY 1")
def status_rate(t: Tables) -> DataFrame:
    return _rounded(mo.status_rate(requests(t)), *[f"rate_{c}xx" for c in (2, 3, 4, 5)])


@query(
    f"""WITH {REQUESTS_SQL}, rates AS (
  SELECT date_trunc('day', ts) AS window_start, path, count(*) / 86400.0::DOUBLE AS r
  FROM requests GROUP BY 1, 2)
SELECT window_start, path, round(r, 6) AS req_per_s,
  row_number() OVER (PARTITION BY window_start ORDER BY r DESC, path)::INTEGER AS rank
FROM rates QUALIFY rank <= 10"""
)
def top_paths(t: Tables) -> DataFrame:
    """Ten busiest of 35 paths per day."""
    return _rounded(mo.top_paths(requests(t), 10, "1 day"), "req_per_s")


def _quantile_sql(q: float) -> str:
    bounds = [0, *mo.LATENCY_BOUNDS]
    cases = " ".join(
        f"WHEN c{i} >= {q}::DOUBLE * n THEN {lo} + ({hi} - {lo}) * ({q}::DOUBLE * n - {f'c{i - 1}' if i else 0})"
        f" / nullif(c{i} - {f'c{i - 1}' if i else 0}, 0)::DOUBLE"
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))
    )
    return f"round(1000 * (CASE {cases} ELSE {bounds[-1]} END), 6) AS p{round(q * 100)}_ms"


_CUMULATIVE_SQL = ", ".join(
    f"count(*) FILTER (duration_s <= {b}) AS c{i}" for i, b in enumerate(mo.LATENCY_BOUNDS)
)


@query(
    f"""WITH {REQUESTS_SQL},
b AS (SELECT {_FIVE}, count(*) AS n, {_CUMULATIVE_SQL} FROM requests GROUP BY 1)
SELECT window_start, n AS n_requests, {", ".join(_quantile_sql(q) for q in (0.5, 0.9, 0.99))} FROM b"""
)
def latency_quantiles(t: Tables) -> DataFrame:
    return _rounded(mo.latency_quantiles(requests(t)), "p50_ms", "p90_ms", "p99_ms")


_LE_SQL = (
    "CASE " + " ".join(f"WHEN duration_s <= {b} THEN '{b:g}'" for b in mo.LATENCY_BOUNDS) + " ELSE '+Inf' END"
)


@query(
    f"WITH {REQUESTS_SQL} SELECT {_FIVE}, {_LE_SQL} AS le, round(count(*) / 300.0::DOUBLE, 6) AS req_per_s "
    "FROM requests GROUP BY 1, 2"
)
def duration_heatmap(t: Tables) -> DataFrame:
    return _rounded(mo.duration_heatmap(requests(t)), "req_per_s")


@query(
    f"WITH {REQUESTS_SQL} SELECT {_MINUTE}, "
    "round(100.0::DOUBLE * count(*) FILTER (status // 100 = 5) / count(*), 6) AS error_pct "
    "FROM requests GROUP BY 1"
)
def error_rate(t: Tables) -> DataFrame:
    return _rounded(mo.error_rate(requests(t)), "error_pct")


@query(
    f"WITH {REQUESTS_SQL} SELECT {_MINUTE}, round(sum(duration_s) / count(*) * 1000, 3) AS avg_ms "
    "FROM requests GROUP BY 1"
)
def latency_avg(t: Tables) -> DataFrame:
    return _naive(mo.latency_avg(requests(t))).withColumn("avg_ms", F.round("avg_ms", 3))


@query(
    f"WITH {REQUESTS_SQL} SELECT job, "
    "round(epoch_us(TIMESTAMP '2024-01-31' - max(ts)) / 1000000.0::DOUBLE, 6) AS uptime_s "
    "FROM requests GROUP BY job"
)
def uptime(t: Tables) -> DataFrame:
    return mo.uptime(requests(t), now()).withColumn("uptime_s", F.round("uptime_s", 6))


@query(
    f"""WITH {REQUESTS_SQL}
SELECT job, {_MINUTE}, max_by(status < 500, struct_pack(ts := ts, event_id := event_id)) AS up
FROM requests GROUP BY ALL"""
)
def last_status(t: Tables) -> DataFrame:
    samples = requests(t).withColumn("up", F.col("status") < 500)
    return _naive(mo.last_status(samples, order=["ts", "event_id"]))


@query(
    f"""WITH {REQUESTS_SQL}, steps AS (
  SELECT method, path, ts AS instant, 1 AS change FROM requests
  UNION ALL SELECT method, path, ts + to_microseconds(round(duration_s * 1000000)::BIGINT), -1 FROM requests),
summed AS (SELECT method, path, instant, sum(change) AS change FROM steps GROUP BY ALL)
SELECT method, path, instant, (sum(change) OVER (PARTITION BY method, path ORDER BY instant))::BIGINT AS in_flight
FROM summed"""
)
def in_flight(t: Tables) -> DataFrame:
    return mo.in_flight(requests(t))


@query(
    f"""WITH {REQUESTS_SQL}, partial AS (
  SELECT CASE WHEN event_id % 5 <> 0 THEN method END AS method, path,
         CASE WHEN event_id % 11 <> 0 THEN ts END AS ts, duration_s FROM requests),
steps AS (
  SELECT method, path, ts AS instant, 1 AS change FROM partial
  UNION ALL SELECT method, path, ts + to_microseconds(round(duration_s * 1000000)::BIGINT), -1 FROM partial),
summed AS (SELECT method, path, instant, sum(change) AS change FROM steps GROUP BY ALL)
SELECT method, path, instant,
       (sum(change) OVER (PARTITION BY method, path ORDER BY instant NULLS FIRST))::BIGINT AS in_flight
FROM summed"""
)
def in_flight_nulls(t: Tables) -> DataFrame:
    """Requests without a method or a time keep their rows."""
    some = requests(t).withColumns(
        {
            "method": F.when(F.col("event_id") % 5 != 0, F.col("method")),
            "ts": F.when(F.col("event_id") % 11 != 0, F.col("ts")),
        }
    )
    return mo.in_flight(some)

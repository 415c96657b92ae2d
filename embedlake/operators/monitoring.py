"""Request-rate, error-rate and latency reports over a request table.

Requests have ``ts, job, method, path, status, duration_s``. Windows are
tumbling and aggregate map-side, so one busy minute or path is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlake.operators.ranking import running_total, time_levels


def _seconds(width: str) -> Column:
    unix = lambda t: F.expr(f"unix_seconds(timestamp'2000-01-01 00:00:00' + interval {t})")
    return (unix(width) - unix("0 seconds")).cast("double")


def _bucket(width: str, ts: str = "ts") -> Column:
    return F.window(ts, width)["start"].alias("window_start")


def requests_per(requests: DataFrame, width: str = "1 hour") -> DataFrame:
    return requests.groupBy(_bucket(width)).agg(F.count("*").alias("n_requests"))


def request_rate(requests: DataFrame, width: str = "1 minute", by: Sequence[str] = ()) -> DataFrame:
    """Requests per second."""
    return requests.groupBy(_bucket(width), *by).agg(
        (F.count("*") / _seconds(width)).alias("req_per_s")
    )


def status_rate(requests: DataFrame, width: str = "1 minute") -> DataFrame:
    """Requests per second by status class."""
    classes = [
        (F.count_if(F.floor(F.col("status") / 100) == c) / _seconds(width)).alias(f"rate_{c}xx")
        for c in (2, 3, 4, 5)
    ]
    return requests.groupBy(_bucket(width)).agg(*classes)


def top_paths(requests: DataFrame, k: int = 10, width: str = "1 minute") -> DataFrame:
    """The k busiest paths of every window; names break ties.

    Spark keeps only k rows per window and task before the shuffle.
    """
    rates = request_rate(requests, width, ["path"])
    order = Window.partitionBy("window_start").orderBy(F.desc("req_per_s"), "path")
    return rates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# Upper bounds of the latency histogram, in seconds; +Inf closes it.
LATENCY_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def latency_quantiles(
    requests: DataFrame,
    quantiles: Sequence[float] = (0.5, 0.9, 0.99),
    bounds: Sequence[float] = LATENCY_BOUNDS,
    width: str = "5 minutes",
) -> DataFrame:
    """Quantiles in ms, interpolated inside the histogram bucket they fall into.

    The cumulative bucket counts are one aggregate per bound. A quantile in the
    open last bucket is the highest finite bound.
    """
    cumulative = [
        F.count_if(F.col("duration_s") <= b).alias(f"__le{i}") for i, b in enumerate(bounds)
    ]
    counts = requests.groupBy(_bucket(width)).agg(
        F.count("duration_s").alias("n_requests"), *cumulative
    )

    def quantile(q: float) -> Column:
        rank = F.lit(q) * F.col("n_requests")
        value = F.when(F.col("n_requests") == 0, F.lit(None).cast("double"))
        below, lower = F.lit(0), 0.0
        for i, upper in enumerate(bounds):
            at = F.col(f"__le{i}")
            inside = lower + (upper - lower) * F.try_divide(rank - below, at - below)
            value = value.when(at >= rank, F.coalesce(inside, F.lit(lower)))
            below, lower = at, upper
        return value.otherwise(F.lit(float(bounds[-1]))) * 1000

    return counts.select(
        "window_start",
        "n_requests",
        *[quantile(q).alias(f"p{round(q * 100)}_ms") for q in quantiles],
    )


def duration_heatmap(
    requests: DataFrame,
    bounds: Sequence[float] = LATENCY_BOUNDS,
    width: str = "5 minutes",
) -> DataFrame:
    """Requests per second in each duration bucket of each window."""
    bucket = F.lit("+Inf")
    for b in reversed(bounds):
        bucket = F.when(F.col("duration_s") <= b, F.lit(f"{b:g}")).otherwise(bucket)
    return request_rate(requests.withColumn("le", bucket), width, ["le"])


def error_rate(requests: DataFrame, width: str = "1 minute") -> DataFrame:
    """Share of 5xx answers in percent, 0 without errors."""
    errors = F.count_if(F.floor(F.col("status") / 100) == 5)
    return requests.groupBy(_bucket(width)).agg(
        F.coalesce(F.try_divide(100.0 * errors, F.count("*")), F.lit(0.0)).alias("error_pct")
    )


def latency_avg(requests: DataFrame, width: str = "1 minute") -> DataFrame:
    return requests.groupBy(_bucket(width)).agg(
        (F.sum("duration_s") / F.count("duration_s") * 1000).alias("avg_ms")
    )


def uptime(starts: DataFrame, now: Column, job: str = "job", ts: str = "ts") -> DataFrame:
    """Seconds since the last start of each job."""
    latest = F.max(ts).cast("timestamp")
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(latest)
    return starts.groupBy(job).agg((micros / 1_000_000).alias("uptime_s"))


def last_status(
    samples: DataFrame,
    value: str = "up",
    by: Sequence[str] = ("job",),
    width: str = "1 minute",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Last sample of every window and job."""
    return samples.groupBy(*by, _bucket(width)).agg(
        F.max_by(value, F.struct(*order)).alias(value)
    )


def gauge_changes(requests: DataFrame, by: Sequence[str] = ("method", "path")) -> DataFrame:
    """+1 at the start and -1 at the end of every request, summed per instant."""
    end = F.col("ts") + F.make_dt_interval(secs=F.col("duration_s").cast("decimal(18,6)"))
    steps = F.inline(
        F.array(
            F.struct(F.col("ts").alias("instant"), F.lit(1).alias("change")),
            F.struct(end.alias("instant"), F.lit(-1).alias("change")),
        )
    )
    return (
        requests.select(*by, "ts", "duration_s")
        .select(*by, steps)
        .groupBy(*by, "instant")
        .agg(F.sum("change").alias("change"))
    )


def in_flight(requests: DataFrame, by: Sequence[str] = ("method", "path")) -> DataFrame:
    """Gauge value right after every instant at which it changed."""
    changes = gauge_changes(requests, by)
    totals = running_total(
        changes, F.col("change"), [F.col("instant")], time_levels(F.col("instant")), by
    )
    return totals.select(*by, "instant", (F.col("before") + F.col("change")).alias("in_flight"))

"""Streams that run in several steps, late rows and malformed lines."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from embedlake.operators import monitoring as mo
from embedlake.operators import tasks as tk
from embedlake.streaming import jobs, state
from embedlake.streaming.changelog import current_rows, read_stream, start_changelog

START = dt.datetime(2024, 1, 1)


def minute(m):
    return START + dt.timedelta(minutes=m)


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def steps(spark, folder, out, mark, build):
    start_changelog(build(read_stream(spark, f"{folder}/*", 1)), out, mark).awaitTermination()


def test_rates_grow_over_restarts(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "ts timestamp, path string"
    first = [(minute(m), "/a") for m in range(0, 20)]
    # The second file is older than the first: a replay without a bound keeps it.
    second = [(minute(m), p) for m in range(-300, 5) for p in ("/a", "/b")]
    build = lambda df: jobs.request_rate(df, lateness=None)
    write(spark, folder, "1", first, schema)
    steps(spark, folder, out, mark, build)
    write(spark, folder, "2", second, schema)
    steps(spark, folder, out, mark, build)
    got = current_rows(spark, out, ["window_start", "path"])
    batch = jobs.request_rate(spark.read.parquet(f"{folder}/*"), lateness=None)
    assert sorted(got.collect()) == sorted(batch.collect())


def test_lateness_bounds_a_live_stream(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "created_at timestamp, ai_model_id string"
    build = lambda df: jobs.daily_usage(df, lateness="1 day")
    days = lambda *d: [(START + dt.timedelta(days=x), "m") for x in d]
    write(spark, folder, "1", days(0, 10), schema)
    steps(spark, folder, out, mark, build)
    # Spark drops late rows by the bound of the batch before.
    write(spark, folder, "2", days(10), schema)
    steps(spark, folder, out, mark, build)
    write(spark, folder, "3", days(0, 11), schema)
    steps(spark, folder, out, mark, build)
    got = {r.day.day: r.n for r in current_rows(spark, out, ["day", "ai_model_id"]).collect()}
    assert got == {1: 1, 11: 2, 12: 1}


def test_task_states_follow_the_log(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "id int, ts timestamp, event_id int, task_status string, error_msg string, progress double"
    write(spark, folder, "1", [(1, minute(0), 0, "Q", None, None), (2, minute(0), 1, "Q", None, None)], schema)
    steps(spark, folder, out, mark, jobs.task_states)
    write(spark, folder, "2", [(1, minute(1), 2, "R", None, 0.5), (1, minute(2), 3, "F", "bad", None)], schema)
    steps(spark, folder, out, mark, jobs.task_states)
    got = {r.id: r for r in current_rows(spark, out, ["id"]).collect()}
    assert (got[1].task_status, got[1].end_date, got[1].error_msg, got[1].progress) == ("F", minute(2), "bad", 0.5)
    assert (got[2].task_status, got[2].end_date) == ("Q", None)
    batch = tk.task_states(
        spark.read.parquet(f"{folder}/*"), tk.RUN_RULE, order=["ts", "event_id"], kept_fields=["progress"]
    )
    assert sorted(map(str, got.values())) == sorted(str(r) for r in batch.select(current_rows(spark, out, ["id"]).columns).collect())


def test_log_lines(spark):
    lines = [
        '{"message": "hi", "time": "2024-01-01T00:00:01.5Z", "level": "INFO"}',
        '{"message": "no time", "time": "yesterday"}',
        "not json",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = jobs.parse_logs(df, F.lit(START).cast("timestamp")).collect()
    assert [r.message for r in got] == ["hi", "no time", "not json"]
    assert [r.ts for r in got] == [START + dt.timedelta(seconds=1.5), START, START]
    assert {r.source for r in got} == {"fastapi"}


def progress(spark, folder, out, mark, build, mode):
    query = start_changelog(build(read_stream(spark, f"{folder}/*", 1)), out, mark, mode)
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_gauge_runs_behind_the_watermark(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "event_id long, method string, path string, ts timestamp, duration_s double"
    rows = [(i, "GET", f"/{i % 2}", minute(m), s) for i, (m, s) in enumerate([(0, 90.5), (3, 30.0), (1, 600.0), (2, 60.0), (5, 0.0), (4, 60.25)])]
    later = [(10 + i, "GET", "/0", minute(m), 30.0) for i, m in enumerate([25, 22, 24])]
    build = lambda df: state.running_gauge(df, lateness="10 minutes")
    write(spark, folder, "1", [*rows[:4], rows[0], rows[2]], schema)
    progress(spark, folder, out, mark, build, "append")
    write(spark, folder, "2", [*rows[4:], rows[1], *later], schema)
    progress(spark, folder, out, mark, build, "append")
    # A row later than the watermark (minute 15) is not counted, a retry within the lateness neither.
    write(spark, folder, "3", [(99, "GET", "/0", minute(1), 1.0), later[0], (100, "GET", "/1", minute(90), 0.0)], schema)
    progress(spark, folder, out, mark, build, "append")
    write(spark, folder, "4", [(101, "GET", "/1", minute(200), 0.0)], schema)
    open_rows = progress(spark, folder, out, mark, build, "append")
    got = spark.read.parquet(out).select("method", "path", "instant", "in_flight")
    requests = spark.createDataFrame([*rows, *later, (100, "GET", "/1", minute(90), 0.0)], schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mo.in_flight(requests).collect()))
    # What is left: the last request's id and instant, and their timer.
    assert open_rows <= 4


def test_tasks_end_once_and_leave_no_state(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "id int, ts timestamp, event_id int, task_status string, error_msg string, progress double"
    build = lambda df: state.task_life(df, "10 minutes", retention_ms=3_600_000)
    first = [(1, minute(5), 3, "D", None, None), (1, minute(0), 0, "Q", None, None), (2, minute(1), 1, "Q", "x", 0.5), (1, minute(2), 2, "R", None, 0.1)]
    write(spark, folder, "1", first, schema)
    progress(spark, folder, out, mark, build, "update")
    write(spark, folder, "2", [(1, minute(20), 4, "R", "late move", 0.9), (2, minute(21), 5, "F", None, None)], schema)
    progress(spark, folder, out, mark, build, "update")
    write(spark, folder, "3", [(3, minute(60), 6, "Q", None, None), (1, minute(3), 7, "F", "too late", None)], schema)
    progress(spark, folder, out, mark, build, "update")
    write(spark, folder, "4", [(3, minute(300), 8, "D", None, None)], schema)
    write(spark, folder, "5", [(3, minute(900), 9, "R", None, None)], schema)
    left = progress(spark, folder, out, mark, build, "update")
    got = {r.id: (r.task_status, r.end_date, r.error_msg, r.progress, r.refused) for r in current_rows(spark, out, ["id"]).collect()}
    assert got[1] == ("D", minute(5), None, 0.1, 1)
    assert got[2] == ("F", minute(21), "x", 0.5, 0)
    assert got[3][:2] == ("D", minute(300))
    # Tasks 1 and 2 are gone; task 3 waits with its last event and a timer.
    assert left <= 4


class Counted:
    """A state of one key that counts the calls for it."""

    def __init__(self, calls):
        self.held, self.calls = None, calls

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.calls.append("clear")
        self.held = None


def test_task_rows_cost_few_columns_and_calls(spark, tmp_path):
    """Each column of a row and each call for state goes between Spark and Python."""
    schema = "id int, ts timestamp, event_id int, task_status string, error_msg string, progress double"
    folder = str(tmp_path / "in")
    events = [(1, minute(5), 3, "R", 'a "b"\n,c', 0.5), (1, minute(5), 2, "Q", "x", None), (1, minute(1), 7, "Q", None, float("inf"))]
    write(spark, folder, "1", events, schema)
    told = state.task_life(spark.readStream.schema(schema).parquet(f"{folder}/*"), "10 minutes")
    log = told._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in log and "to_json" in log
    packed = spark.createDataFrame(events, schema).select("id", "ts", state.packed_event().alias("event")).collect()

    calls, timers = [], []
    handle = SimpleNamespace(getValueState=lambda *_: Counted(calls), registerTimer=timers.append)
    task = state._TaskLife(1_000)
    task.init(handle)
    list(task.handleInputRows((1,), iter(packed[2:]), None))
    list(task.handleInputRows((1,), iter(packed[:2]), None))
    # Later rows need no timer of their own.
    assert calls == ["get", "update"] * 2 and len(timers) == 1
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 4_000_000_000_000)
    (row,) = task.handleExpiredTimer((1,), passed, None)
    assert row.asDict() == {"id": 1, "task_status": "R", "end_us": None, "error_msg": 'a "b"\n,c', "progress": 0.5, "refused": 0}


def test_an_unknown_id_takes_no_tasks_with_it(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "id int, ts timestamp, event_id int, task_status string, error_msg string, progress double"
    rows = [(i, minute(1), i, "D", None, None) for i in range(40)]
    write(spark, folder, "1", [*rows, (None, minute(2), 40, "Q", None, None)], schema)
    write(spark, folder, "2", [(99, minute(900), 41, "Q", None, None)], schema)
    progress(spark, folder, out, mark, lambda df: state.task_life(df, "10 minutes"), "update")
    assert {r.id for r in current_rows(spark, out, ["id"]).collect()} - {None} == set(range(40))

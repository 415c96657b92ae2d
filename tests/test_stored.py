"""Stored listings, bucketed registry tables and compacted change logs."""

import os

from pyspark.sql import functions as F

from embedlake.operators import ranking, registry as rg, snapshots
from embedlake.streaming import changelog


def scans(frame):
    return str(frame._jdf.queryExecution().optimizedPlan()).count("Relation [")


def test_pages_of_a_stored_listing(spark, tmp_path):
    path = str(tmp_path / "pages")
    ids = [None, None, *["hot"] * 700, *[f"k{i:04d}" for i in range(500)]]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(ids)], "id string, n int")
    rg.write_listing(rows.repartition(7), path, range_rows=100)
    seen = []
    for offset in range(0, 1300, 130):
        page = rg.read_page(spark, path, 130, offset)
        held = page.collect()
        seen += [(r["id"], r["n"]) for r in held]
        assert {r["total"] for r in held} <= {len(ids)}
        assert "Exchange hashpartitioning" not in str(page._jdf.queryExecution().executedPlan())
    assert [k for k, _ in seen] == ids and sorted(n for _, n in seen) == list(range(len(ids)))
    # A hot key is spread over ranges, so a page reads a few hundred rows at most.
    files = [f for f in os.listdir(f"{path}/rows") if f.startswith("__range")]
    assert len(files) >= 8
    empty = str(tmp_path / "empty")
    rg.write_listing(rows.limit(0), empty)
    assert rg.read_page(spark, empty, 10).count() == 0


def test_far_pages_equal_near_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(None if i % 50 == 0 else i % 300, str(i)) for i in range(2000)], "id int, v string").repartition(5)
    near = [rg.page_by_offset(rows, 100, o).collect() for o in range(0, 2100, 100)]
    monkeypatch.setattr(rg, "NEAR_ROWS", 0)
    assert [rg.page_by_offset(rows, 100, o).collect() for o in range(0, 2100, 100)] == near
    assert sorted(r["v"] for page in near for r in page) == sorted(str(i) for i in range(2000))


def test_updates_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(400).select("id", F.lit(0).alias("version"), F.lit("old").alias("name"))
    snapshots.create(rows, path, buckets=16)
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}
    before = files()
    assert len(before) == 16
    updates = spark.createDataFrame(
        [(7, 0, "new", 1), (7, 1, "newer", 2), (8, 3, "stale", 3), (1000, 0, "lost", 4)], "id long, expected_version int, name string, seq long"
    )
    told = {(r["id"], r["seq"]): r["outcome"] for r in snapshots.update(spark, path, updates, ["name"]).collect()}
    assert told == {(7, 1): "updated", (7, 2): "updated", (8, 3): "version_mismatch", (1000, 4): "not_found"}
    assert len(before - files()) <= 3 and len(files()) == 16
    gone = spark.createDataFrame([(7, 0), (9, 0), (5000, 0)], "id long, expected_version int")
    told = {r["id"]: r["outcome"] for r in snapshots.delete(spark, path, gone, version="version").collect()}
    assert told == {7: "version_mismatch", 9: "updated", 5000: "not_found"}
    held = {r["id"]: (r["version"], r["name"]) for r in snapshots.read(spark, path).collect()}
    assert set(held) == set(range(400)) - {9} and held[7] == (2, "newer") and held[8] == (0, "old")
    snapshots.delete(spark, path, rows.select("id"))
    assert snapshots.read(spark, path).count() == 0 and len(files()) == 16
    told = snapshots.update(spark, path, updates.limit(1), ["name"]).collect()
    assert [r["outcome"] for r in told] == ["not_found"]


def test_compacted_logs_read_the_same(spark, tmp_path):
    out = str(tmp_path / "log")

    def put(batch, rows):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    state = lambda: dict(map(tuple, changelog.current_rows(spark, out, ["k"]).collect()))
    for batch in range(9):
        put(batch, [("a", batch), (f"b{batch}", batch)])
    expected = {"a": 8, **{f"b{i}": i for i in range(9)}}
    assert state() == expected
    changelog.compact(spark, out, ["k"], 5)
    assert state() == expected
    # The newest batch may come again with other rows.
    put(8, [("a", 80)])
    expected |= {"a": 80}
    del expected["b8"]
    assert state() == expected
    changelog.compact(spark, out, ["k"], 7)
    assert state() == expected
    left = sorted(f for f in os.listdir(out))
    assert left == ["batch_id=6", "batch_id=7", "batch_id=8", "upto=5", "upto=7"]
    # A base that was not finished does not count.
    os.mkdir(f"{out}/upto=8")
    assert state() == expected
    changelog.compact(spark, out, ["k"], 8)
    assert state() == expected


def test_samples_read_their_input_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(3000).withColumn("k", F.col("id") % 900).write.parquet(path)
    rows = spark.read.parquet(path)
    sample = ranking.exact_sample(rows, 250, ["k"])
    assert scans(sample) == 1
    once = sorted(r["k"] for r in sample.collect())
    monkeypatch.setattr(ranking, "TOP_ROWS", 0)
    assert sorted(r["k"] for r in ranking.exact_sample(rows, 250, ["k"]).collect()) == once and len(once) == 250


def test_empty_tables_are_stored(spark, tmp_path):
    path = str(tmp_path / "none")
    rows = spark.createDataFrame([], "id long, version int, name string")
    snapshots.create(rows, path)
    assert snapshots.read(spark, path).collect() == []
    gone = spark.createDataFrame([(1,)], "id long")
    assert [r["outcome"] for r in snapshots.delete(spark, path, gone).collect()] == ["not_found"]

"""Every registered query against its SQL twin, and the shape of the plans."""

import os

import pytest

import __spark_entry__ as entry
from embedlake.plans import catalog
from oracle import connect, differences

FOLDER = os.environ.get("EMBEDLAKE_TEST_DATA", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


def test_all_have_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plans_stay_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for bad in ["Python", "CartesianProduct", "BroadcastNestedLoopJoin"]:
        assert bad not in text, f"{bad} in {name}"


def test_scans_are_pruned(spark):
    text = plan(QUERIES["token_usage"](spark, FOLDER))
    assert "ReadSchema: struct<text:string,lang:string,source:string>" in text
    text = plan(QUERIES["request_rate"](spark, FOLDER))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_feed_filters_reach_the_scans(spark):
    text = plan(QUERIES["task_feed_by_tag"](spark, FOLDER))
    assert text.count("EqualTo(event_type,") == 2 and "click" not in text


def test_top_paths_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top_paths"](spark, FOLDER))


def test_no_broadcast_is_forced(spark):
    """Sides are only broadcast after Spark has measured them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ["task_feed", "toplevel_dirs", "duplicate_guard", "cosine_pairs"]:
            assert "BroadcastExchange" not in plan(QUERIES[name](spark, FOLDER)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

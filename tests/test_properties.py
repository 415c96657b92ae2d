"""Properties that hold for generated input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embedlake.functions import text as tx
from embedlake.functions.vectors import cosine
from embedlake.operators import ranking as rk, training as tr

few = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
floats = st.floats(-1e6, 1e6, width=32)
vectors = st.lists(st.tuples(*[st.lists(floats, min_size=4, max_size=4)] * 2), min_size=1, max_size=20)


@few
@given(vectors)
def test_cosine_is_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    got = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert all(-1 - 1e-9 <= c <= 1 + 1e-9 for c in got)


@few
@given(st.sets(st.integers(-(2**62), 2**62), min_size=1, max_size=60))
def test_positions_follow_any_key(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = rk.row_position(df, [F.col("k")], rk.radix_levels(F.col("k"))).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.position)] == sorted(keys)
    assert {r.position for r in got} == set(range(len(keys)))


@few
@given(st.lists(st.tuples(st.text(max_size=5), st.text(max_size=5), st.text(max_size=5)), min_size=1, max_size=20))
def test_examples_match_python_strip(spark, rows):
    df = spark.createDataFrame(rows, "question string, positive string, negative string")
    got = {(r.text_a, r.text_b, r.label) for r in tr.training_examples(df).collect()}
    expected = set()
    for row in rows:
        q, p, n = (x.strip() for x in row)
        if q and p and n:
            expected |= {(q, p, 1.0), (q, n, -1.0)}
    assert got == expected


@few
@given(st.lists(st.text(max_size=8), min_size=1, max_size=20))
def test_escaped_cells_never_start_a_formula(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    for row in df.select("c", tx.escape_formula(F.col("c")).alias("e")).collect():
        visible = row.c.lstrip("".join(map(chr, range(33))))
        assert (row.e == "'" + row.c) == visible.startswith(("=", "+", "-", "@"))


def test_all_unicode_white_space_is_blank(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    rows = [(i, c + "x" + c, c, "n") for i, c in enumerate(spaces)] + [(99, "q", "\u200b", "n")]
    df = spark.createDataFrame(rows, "k int, question string, positive string, negative string")
    got = tr.training_examples(df, ["k"]).filter("slot = 0").collect()
    assert [(r.k, r.text_b) for r in got] == [(99, "\u200b")]
    kept = tr.training_examples(df.withColumn("positive", F.lit("p")), ["k"]).filter("slot = 0")
    assert {r.text_a for r in kept.collect()} == {"x", "q"}

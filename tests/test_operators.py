"""Operators on small frames against independent plain-Python results."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlake.functions import text as tx
from embedlake.functions.vectors import cosine, prefix
from embedlake.operators import archives, canonical as cn, encoder, evaluation as ev
from embedlake.operators import monitoring as mo, ranking as rk, registry as rg
from embedlake.operators import synthesis as sy, tasks as tk, training as tr, usage as us


def values(spark, column, cells, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r.v for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


# ---- ranking ---------------------------------------------------------------


def brute_running_total(rows):
    out, seen = {}, {}
    for group, key, value in sorted(rows):
        out[group, key] = seen.get(group, 0)
        seen[group] = seen.get(group, 0) + value
    return out


@pytest.mark.parametrize("spread", [10, 2**21, 2**45])
def test_running_total_over_cells(spark, spread):
    rng = random.Random(spread)
    # Group "hot" holds most rows; keys cross many cells and include negatives.
    rows = list({
        (rng.choice(["hot", "hot", "hot", "cold"]), rng.randrange(-spread, spread)): 0
        for _ in range(400)
    })
    rows = [(g, k, rng.randrange(1, 9)) for g, k in rows]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = rk.running_total(df, F.col("v"), [F.col("k")], rk.radix_levels(F.col("k")), ["g"])
    assert {(r.g, r.k): r.before for r in got.collect()} == brute_running_total(rows)


def test_row_position_without_groups(spark):
    df = spark.createDataFrame([(k * 3_000_000,) for k in range(50)], "k long")
    got = rk.row_position(df, [F.col("k")], rk.radix_levels(F.col("k")))
    assert [r.position for r in got.orderBy("k").collect()] == list(range(50))


def brute_sample(ids, n, seed=42):
    return set(sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))[:n])


@pytest.mark.parametrize("chars", [1, 3])
def test_samples_are_exact(spark, monkeypatch, chars):
    monkeypatch.setattr(rk, "CELL_CHARS", chars)
    monkeypatch.setattr(rk, "TOP_ROWS", 0 if chars == 1 else 100)
    df = spark.range(1000).withColumnRenamed("id", "q_id")
    for n in [0, 1, 100, 999, 1000, 5000]:
        got = {r.q_id for r in ev.sample(df.repartition(7), n).collect()} if n else set()
        assert got == brute_sample(range(1000), n), n
    assert ev.sample(df, None).count() == 1000
    assert {r.q_id for r in ev.sample(df, 100, seed=7).collect()} == brute_sample(range(1000), 100, 7)


def test_samples_keep_rows_with_equal_keys_apart(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(20)], "a int, b int")
    assert rk.exact_sample(df, 7, ["a", "b"]).count() == 7


# ---- vectors and evaluation --------------------------------------------------


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], [-2.0, -4.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, -1.0])


def test_prefix_is_not_padded(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    cut = lambda d: df.select(prefix(F.col("v"), d).alias("p")).first().p
    assert cut(2) == [1.0, 2.0] and cut(9) == [1.0, 2.0, 3.0] and cut(None) == [1.0, 2.0, 3.0]


def average_ranks(scores):
    ordered = sorted(scores)
    first = {}
    last = {}
    for i, s in enumerate(ordered, 1):
        first.setdefault(s, i)
        last[s] = i
    return [(first[s] + last[s]) / 2 for s in scores]


def brute_metrics(pairs):
    pos, neg = [p for p, _ in pairs], [n for _, n in pairs]
    scores = [round(s, 9) for s in pos + neg]
    if len(set(scores)) <= 1:
        rho = 0.0
    else:
        labels = [1.0] * len(pos) + [0.0] * len(neg)
        rho = float(np.corrcoef(average_ranks(labels), average_ranks(scores))[0, 1])
    mp, mn = sum(pos) / len(pos), sum(neg) / len(neg)
    return mp, mn, (mp / mn if mn > 0 else math.inf), rho, len(pos)


CASES = {
    "random": [(random.Random(i).uniform(-1, 1), random.Random(i + 99).uniform(-1, 1)) for i in range(300)],
    "tied": [(0.5, 0.5), (0.5, 0.1), (0.1, 0.5), (0.9, 0.1)],
    "equal": [(0.3, 0.3)] * 5,
    "zero_negative": [(0.4, 0.2), (0.2, -0.2)],
    "negative_ratio": [(-0.4, 0.2), (-0.2, 0.1)],
    "single": [(0.8, 0.3)],
    "ends": [(1.0, -1.0), (1.0, 1.0)],
}


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = [(name, float(p), float(n)) for name, pairs in CASES.items() for p, n in pairs]
    scores = spark.createDataFrame(rows, "model string, pos_sim double, neg_sim double")
    return {r.model: r for r in ev.evaluate(scores, ["model"]).collect()}


@pytest.mark.parametrize("name", CASES)
def test_metrics(evaluated, name):
    row = evaluated[name]
    got = (row.avg_positive_similarity, row.avg_negative_similarity, row.similarity_ratio,
           row.spearman_correlation, row.num_samples)
    assert got == pytest.approx(brute_metrics(CASES[name]), abs=1e-9)
    assert row.valid == (name != "negative_ratio")


def test_no_rows_give_no_metrics(spark):
    empty = spark.createDataFrame([], "pos_sim double, neg_sim double")
    assert ev.evaluate(empty).collect() == []


def test_comparison_and_summaries(spark):
    rows = [("trained", 0.8, 0.3, 0.8 / 0.3, 0.7, 100), ("baseline", 0.5, -0.1, math.inf, 0.2, 100)]
    df = spark.createDataFrame(rows, "model string, " + ev.METRICS_SCHEMA)
    row = ev.compare(df).withColumn("line", ev.improvement_line()).first()
    assert row.positive_similarity_improvement == pytest.approx(0.3)
    assert row.line == "Similarity ratio improved by -inf (inf → 2.667)"
    texts = {r.model: r for r in ev.summaries(df, ["model"]).collect()}
    assert texts["trained"].summary == "Positive similarity: 0.800, Negative similarity: 0.300, Ratio: 2.667"
    assert texts["baseline"].ratio == "inf"


def test_fixed_decimals_match_python(spark):
    numbers = [0.0, -0.0001, 0.125, 0.0625, -0.0625, 2.5, -1.2345678, 1e6, math.inf, -math.inf]
    for decimals in (2, 3, 4):
        got = values(spark, lambda c: ev.shown(c, decimals), numbers, "double")
        assert got == [f"{x:.{decimals}f}" for x in numbers]


def test_lenient_metrics_json(spark):
    good = '{"avg_positive_similarity": 0.8, "num_samples": 3}'
    df = spark.createDataFrame([(good,), ("{broken",), (None,)], "metrics_json string")
    got = [r.metrics for r in ev.from_json(df).collect()]
    assert got[0].avg_positive_similarity == 0.8 and got[0].num_samples == 3
    assert got[1] is None and got[2] is None


def test_mean_pool_masks_padding(spark):
    rows = [("d", [1.0, 2.0], 1), ("d", [3.0, 4.0], 1), ("d", [100.0, 100.0], 0), ("e", [5.0, 6.0], 0)]
    df = spark.createDataFrame(rows, "doc string, embedding array<float>, mask int")
    got = {r.doc: r.embedding for r in encoder.mean_pool(df, ["doc"]).collect()}
    assert got == {"d": [2.0, 3.0], "e": [None, None]}
    long = spark.createDataFrame([("d", [1.0] * 300, 1), ("d", [3.0] * 300, 1)], df.schema)
    assert encoder.mean_pool(long, ["doc"]).first().embedding == [2.0] * 300
    with pytest.raises(Exception, match="unequal length"):
        encoder.mean_pool(df.unionByName(long), ["doc"]).collect()


def test_encoders(spark):
    df = spark.createDataFrame([("a b",), ("a b " + "c " * 500,), ("",)], "t string")
    counts = encoder.token_usage(df, "t").first()
    assert (counts.n_inputs, counts.prompt_tokens, counts.untruncated_tokens) == (3, 130, 504)
    cut = encoder.token_prefix(df, "t").orderBy(F.length("t")).collect()
    assert [r.n_tokens for r in cut] == [0, 2, 128] and cut[1].tokens_text == "a b"
    ids = spark.createDataFrame([(list(range(300)),), (None,)], "t array<int>")
    whole = encoder.token_prefix(ids, "t").collect()
    assert whole[0].n_tokens == 300 and whole[0].tokens_text.endswith(" 299") and whole[1].n_tokens is None
    adapted = encoder.encode_with_model(df, "t", "m", lambda tag: lambda texts: [[len(x), 1] for x in texts])
    assert [r.embedding for r in adapted.collect()][0] == [3.0, 1.0]


def test_model_cache_keeps_ten():
    loads = []
    for tag in [*"abcdefghij", "a", "k", "b", "a"]:
        encoder.loaded_model("cache-" + tag, lambda t: loads.append(t) or t)
    assert loads == ["cache-" + t for t in [*"abcdefghij", "k", "b"]]


# ---- text --------------------------------------------------------------------


def test_delimiters(spark):
    cells = ["a,b;c;d", "a\tb", "a|b,c", "plain", "", "x" * 1024 + ",,,,"]
    assert values(spark, tx.delimiter, cells) == [";", "\t", ",", ";", ";", ";"]
    assert values(spark, lambda c: tx.delimiter(c, None), cells[-1:]) == [","]


def test_formula_escape(spark):
    cells = ["=1", " \t-x", "\x01@a", "a=1", "'=1", "", None, "+"]
    assert values(spark, tx.escape_formula, cells) == ["'=1", "' \t-x", "'\x01@a", "a=1", "'=1", "", None, "'+"]


def test_cell_rules(spark):
    cells = ['a"b', 'say ""hi""', '"say ""hi"""', "a,b", '"a,b"', "a|b", "a\nb", "fine", '"a" b', None]
    assert values(spark, tx.cell_violation, cells) == [
        "unbalanced_quotes", "double_quotes", None, "special_characters", None,
        "special_characters", "special_characters", None, None, None,
    ]


def test_names(spark):
    paths = ["dir/ä b.CSV", "; rm -rf %2F.csv", "x.txt", "noext", ".csv", "a.b.jsonl", "n" * 256 + ".csv", "a."]
    got = values(spark, lambda c: tx.sanitized_name(c)["file_name"], paths)
    assert got == ["__b.csv", "__rm_-rf__2F.csv", None, None, None, "a_b.jsonl", None, None]
    errors = values(spark, lambda c: tx.sanitized_name(c)["name_error"], paths)
    assert errors[2] == "unsupported_format" and errors[3] == "filename_missing"
    assert errors[4] == "filename_missing" and errors[6] == "filename_too_long"


def test_tags_sizes_versions_statuses(spark):
    assert values(spark, tx.normalized_model_tag, ["org_name", "models--a_b", "models/x_y", "my_finetuned"]) == [
        "models--org--name", "models--a--b", "models/x_y", "my_finetuned",
    ]
    sizes = values(spark, tx.readable_size, [512, 1024, 1152, 5 * 1024**2, 3 * 1024**3], "long")
    assert sizes == ["512 bytes", "1.00 KB", "1.12 KB", "5.00 MB", "3.00 GB"]
    assert values(spark, tx.expected_version, ['"3"', " \"12\" ", "3", '"x"', '""']) == [3, 12, None, None, None]
    assert values(spark, tx.decoded_status, ["Q", "running", "DONE", "x", None]) == ["Q", "R", "D", "F", "F"]
    good = "0a9d5e87-e497-4737-9829-2070780d10df"
    assert values(spark, tx.is_uuid, [good, good[:-1], "x"]) == [True, False, False]


def test_file_gates(spark):
    df = spark.createDataFrame(
        [("a,b", "csv"), ("=SUM(1)", "csv"), ("=SUM(1)", "xlsx"), ("", "csv"), ("a\x00", "csv"), ("a", "txt"), ("m@x", "json")],
        "t string, e string",
    )
    got = [r.v for r in df.select(tx.content_verdict(F.col("t"), F.col("e")).alias("v")).collect()]
    assert got == [None, "malicious_content", None, "empty_file", "nul_byte", "unsupported_format", "malicious_content"]


# ---- canonical ----------------------------------------------------------------


def test_header_resolution():
    assert cn.resolve_headers(["Prompt", "CHOSEN", "x"]) == {"question": "Prompt", "positive": "CHOSEN"}
    assert cn.resolve_headers(["anchor", "question", "answer", "no_context"]) == {
        "question": "question", "positive": "answer", "negative": "no_context",
    }
    assert cn.resolve_headers(["a", "B", "q"], {"question": "b", "positive": "A", "negative": None}) == {
        "question": "B", "positive": "a",
    }
    with pytest.raises(cn.ColumnError, match="positive"):
        cn.resolve_headers(["question"])
    with pytest.raises(cn.ColumnError, match="zzz"):
        cn.resolve_headers(["question", "positive"], {"negative": "zzz"})


def test_schema_table():
    assert len(cn.ALLOWED_SCHEMAS) == 34
    assert sorted(len(s) for s in cn.ALLOWED_SCHEMAS).count(2) == 7
    assert cn.schema_mapping(["prompt", "chosen", "response_b"]) == {"question": "prompt", "positive": "chosen"}
    with pytest.raises(cn.ColumnError):
        cn.schema_mapping(["nothing"])


def test_validation_report(spark):
    rows = [("a", "b", "c"), (None, "b", "c"), ("a", " \n", None)]
    df = spark.createDataFrame(rows, "question string, positive string, negative string")
    row = cn.validation_report(df).first()
    assert (row.num_rows, row.null_question, row.blank_positive, row.null_negative, row.valid_rows) == (3, 1, 1, 1, 1)
    assert row.error == "Column 'question' contains 1 null values"
    assert cn.validation_report(df.limit(0)).first().error == "dataset is empty"
    assert cn.require_valid(df.limit(1)).count() == 1
    with pytest.raises(Exception, match="triplet with a null"):
        cn.require_valid(df).collect()


# ---- training ------------------------------------------------------------------


def test_examples_skip_blanks(spark):
    rows = [(1, " a ", "b", "c"), (2, "a", " ", "c"), (3, "a", "b", None)]
    df = spark.createDataFrame(rows, "k int, question string, positive string, negative string")
    got = [(r.text_a, r.text_b, r.label) for r in tr.training_examples(df, ["k"]).collect()]
    assert got == [("a", "b", 1.0), ("a", "c", -1.0)]


@pytest.mark.parametrize("n", [1, 4, 5, 15, 33])
def test_split_can_cut_a_pair(spark, n):
    keys = spark.range(n).withColumn("d", F.lit(1))
    got = tr.split_by_position(keys, ["d"], [F.col("id")], rk.radix_levels(F.col("id"))).collect()
    assert sorted(r.position for r in got) == list(range(2 * n))
    assert sum(r.split == "validation" for r in got) == int(0.1 * 2 * n)
    assert all(r.split == ("validation" if r.position < int(0.2 * n) else "train") for r in got)


def test_hash_split_is_stable(spark):
    df = tr.hash_split(spark.range(20_000), ["id"])
    share = df.filter("split = 'validation'").count() / 20_000
    assert 0.08 < share < 0.12
    assert tr.hash_split(spark.range(1000), ["id"], 1.0).filter("split = 'train'").count() == 0
    assert tr.hash_split(spark.range(1000), ["id"], 0.0).filter("split = 'validation'").count() == 0


def test_throughput(spark):
    df = spark.createDataFrame([(10, 2.0, 4, 3), (10, 0.0, 4, 1)], "n_samples long, runtime_s double, batch_size int, epochs int")
    a, b = tr.throughput(df).collect()
    assert (a.total_steps, a.train_samples_per_second, a.train_steps_per_second) == (9, 5.0, 4.5)
    assert (b.train_samples_per_second, b.train_steps_per_second) == (0.0, 0.0)


# ---- registry -------------------------------------------------------------------


def brute_updates(current, updates):
    state, outcomes = dict(current), {}
    for key, expected, seq in sorted(updates, key=lambda u: u[2]):
        if key not in state:
            outcomes[seq] = "not_found"
        elif state[key] != expected:
            outcomes[seq] = "version_mismatch"
        else:
            state[key] += 1
            outcomes[seq] = "updated"
    return state, outcomes


def test_update_chains_match_sequential_order(spark):
    rng = random.Random(5)
    current = {k: rng.randrange(3) for k in range(20)}
    # Key 0 gets a third of all updates.
    updates = [
        (0 if i % 3 == 0 else rng.randrange(25), rng.randrange(6), i) for i in range(150)
    ]
    cur = spark.createDataFrame([(k, v, f"n{k}") for k, v in current.items()], "id int, version int, name string")
    upd = spark.createDataFrame([(*u, f"u{u[2]}") for u in updates], "id int, expected_version int, seq int, name string")
    outcome, snapshot = rg.optimistic_update(cur, upd, ["name"])
    state, outcomes = brute_updates(current, updates)
    assert {r.id: r.version for r in snapshot.collect()} == state
    assert {r.seq: r.outcome for r in outcome.collect()} == outcomes


def test_lineage_depths_and_cycles(spark):
    edges = [(0, None)] + [(i, i - 1) for i in range(1, 30)] + [(100, 99)] + [(200 + i, 0) for i in range(50)]
    df = spark.createDataFrame(edges, "id long, trained_from_id long")
    got = {r.id: (r.root_id, r.depth) for r in rg.lineage(df).collect()}
    assert got[29] == (0, 29) and got[0] == (0, 0) and got[100] == (99, 1) and got[249] == (0, 1)
    loop = spark.createDataFrame([(1, 2), (2, 1)], "id long, trained_from_id long")
    loop = loop.union(spark.createDataFrame([(3, 1), (4, None), (5, 4)], loop.schema))
    got = {r.id: (r.root_id, r.depth) for r in rg.lineage(loop).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (4, 0), 5: (4, 1)}


def test_model_guard_and_requests(spark):
    found = spark.createDataFrame([("a/b",), ("new model",)], "dir string")
    registry = spark.createDataFrame([("a_b",)], "model_tag string")
    got = {r.safe_tag: r.exists for r in rg.new_and_existing(found, registry, "dir", "model_tag").collect()}
    assert got == {"a_b": True, "new_model": False}
    df = spark.createDataFrame([(0, None), (2, None), (None, "d")], "n int, d string")
    got = [r.e for r in df.select(sy.request_error(F.col("n"), F.col("d")).alias("e")).collect()]
    assert got == ["nothing_given", None, None]
    df = spark.createDataFrame([("a.csv", None), ("a.tsv", 0), ("a.json", 5), ("a.JSONL", 5)], "p string, n int")
    got = [r.e for r in df.select(tx.training_file_error(F.col("p"), F.col("n")).alias("e")).collect()]
    assert got == ["file_not_found", "empty_file", "unsupported_format", None]
    assert cn.missing_columns(["Question", "positive"]) == ["question", "negative"]


def test_prefix_guard(spark):
    req = spark.createDataFrame([(1, "org/a"), (2, "org/b"), (3, "run"), (4, "org/abcd"), (5, "%_")], "r int, tag string")
    reg = spark.createDataFrame([("org/a_train",), ("org/abc",), ("x",)], "name string")
    running = spark.createDataFrame([("run",), ("org/a",)], "tag string")
    got = {r.r: r.verdict for r in rg.duplicate_guard(req, reg, running).collect()}
    assert got == {1: "already_exists", 2: "admitted", 3: "being_uploaded", 4: "admitted", 5: "admitted"}


def test_pages_are_disjoint_and_ordered(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    first = [r.id for r in rg.page_by_number(df, 1, 10).collect()]
    assert first == list(range(10))
    far = rg.page_by_offset(df, 7, 30).collect()
    assert [r.id for r in far] == list(range(30, 37)) and far[0].total == 100
    odd = spark.createDataFrame([(k,) for k in ["b", None, "a", "b", "c", None]], "id string")
    pages = [[r.id for r in rg.page_by_offset(odd, 2, o).collect()] for o in (0, 2, 4, 6)]
    assert pages == [[None, None], ["a", "b"], ["b", "c"], []]
    with pytest.raises(ValueError):
        rg.page_by_number(df, 0, 10)


# ---- tasks, usage, monitoring ------------------------------------------------------


def test_feed_window_and_order(spark):
    schema = "id int, task_status string, created_at timestamp_ntz, end_date timestamp_ntz, error_msg string"
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "Q", day(1), None, None), (2, "D", day(2), day(3), None), (3, "D", day(3), day(9), None), (4, "D", day(4), None, None)]
    tables = {"synthesis": spark.createDataFrame(rows, schema)}
    now = F.lit(day(10))
    feed = tk.task_feed(tables, now, 48, task_types=["synthesis"])
    assert [r.id for r in tk.newest_first(feed).collect()] == [4, 3, 1]
    assert [r.id for r in tk.newest_first(feed, 1, 1).collect()] == [3]
    assert [r.id for r in tk.newest_first(feed, after=(day(3), "synthesis", 3)).collect()] == [1]
    assert {r.tag for r in feed.collect()} == {None}
    with pytest.raises(ValueError):
        tk.newest_first(feed, 101)


def test_state_rules(spark):
    rows = [(1, 1, "R", None, None), (1, 2, "F", "bad", 0.5), (1, 3, "D", None, None)]
    log = spark.createDataFrame(rows, "id int, ts int, task_status string, error_msg string, progress double")
    fold = lambda rule: tk.task_states(log, rule, kept_fields=["progress"]).first()
    up, run, ev_ = fold(tk.UPLOAD_RULE), fold(tk.RUN_RULE), fold(tk.EVALUATION_RULE)
    assert (up.task_status, up.end_date, up.error_msg) == ("D", 3, None)
    assert (run.end_date, run.error_msg, run.progress) == (3, "bad", 0.5)
    assert (ev_.end_date, ev_.error_msg) == (None, "bad")


def test_usage_gaps(spark):
    models = spark.createDataFrame([("m", "2024-01-01"), ("n", "2024-01-03")], "ai_model_id string, created_at string")
    use = spark.createDataFrame([("m", "2024-01-02"), ("m", "2024-01-02")], "ai_model_id string, created_at string")
    ts = lambda df: df.withColumn("created_at", F.to_timestamp("created_at"))
    got = us.daily_usage(ts(models), ts(use), F.lit("2024-01-04").cast("date")).collect()
    assert {(r.ai_model_id, str(r.day), r.n) for r in got} == {
        ("m", "2024-01-01", 0), ("m", "2024-01-02", 2), ("m", "2024-01-03", 0), ("m", "2024-01-04", 0),
        ("n", "2024-01-03", 0), ("n", "2024-01-04", 0),
    }


def test_histogram_quantile(spark):
    rows = [(f"2024-01-01 00:00:0{i}", d) for i, d in enumerate([0.5, 2.0, 4.0, 20.0, 999.0])]
    df = spark.createDataFrame(rows, "ts string, duration_s double").withColumn("ts", F.to_timestamp("ts"))
    row = mo.latency_quantiles(df).first()
    # rank 2.5 lies in (1, 5]: 1 + 4 * (2.5 - 1) / 2; rank 4.95 in the open bucket
    assert row.p50_ms == pytest.approx(4000.0) and row.p99_ms == 500_000.0


def brute_in_flight(rows):
    instants = {}
    for path, start, length in rows:
        instants.setdefault((path, start), 0)
        instants.setdefault((path, start + length), 0)
    return {
        (p, t): sum(1 for q, s, n in rows if q == p and s <= t < s + n) for p, t in instants
    }


def test_in_flight_gauge(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(200_000), rng.randrange(1, 90_000)) for _ in range(120)]
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "path string, s int, n int").select(
        F.lit("GET").alias("method"), "path",
        (base + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))).alias("ts"),
        F.col("n").cast("double").alias("duration_s"),
    )
    got = mo.in_flight(df).select(
        "path", F.timestamp_diff("SECOND", base, F.col("instant")).alias("t"), "in_flight"
    )
    assert {(r.path, r.t): r.in_flight for r in got.collect()} == brute_in_flight(rows)


# ---- archives ------------------------------------------------------------------------


def brute_layout(names):
    ext = (".pt", ".pth", ".bin", ".model", ".safetensors")
    dirs = {n.rsplit("/", 1)[0] for n in names if "/" in n and n.lower().endswith(ext)}
    top = {d for d in dirs if not any(d != o and d.startswith(o + "/") for o in dirs)}
    if top:
        return {(n, d) for d in top for n in names if n.startswith(d + "/")}
    return {(n, n.split("/")[0]) for n in names if "/" in n}


@pytest.mark.parametrize("names", [
    ["m/a.bin", "m/sub/b.pt", "m/c.json", "n/x/y.safetensors", "n/readme", "top.bin"],
    ["a/b.txt", "a/c/d.txt", "e/f", "g"],
    ["mm/a.BIN", "m/b.bin", "m/b/c.bin"],
])
def test_archive_layout(spark, names):
    df = spark.createDataFrame([("z", n) for n in names], "archive string, member string")
    got = {(r.member, r.model_dir) for r in archives.toplevel_directories(df).collect()}
    assert got == brute_layout(names)


def test_extraction_targets(spark):
    df = spark.createDataFrame(
        [("z", "m/x/a.bin", "m"), ("z", "m/x/y/b.json", "m"), ("z", "m/x/c.txt", "m")],
        "archive string, member string, model_dir string",
    )
    got = {r.member: (r.common_prefix, r.target) for r in archives.extraction_plan(df).collect()}
    assert got == {"m/x/a.bin": ("m/x", "a.bin"), "m/x/y/b.json": ("m/x", "y/b.json"), "m/x/c.txt": ("m/x", None)}


def test_scores_without_rows_of_three_vectors(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0, 2.0]), (5, None)],
        "vec_id long, embedding array<float>",
    )
    ids = [1, 2, 3, 4, 5, 9, None]
    rows = [(q, p, n, f"{q}") for q in ids for p in ids for n in ids] + [(1, 2, 3, "1")]
    triplets = spark.createDataFrame(rows, "q_id long, p_id long, n_id long, label string")
    joined = ev.attach_vectors(triplets, vectors)
    keep = ["q_id", "p_id", "n_id", "label"]
    fused = ev.score_triplets(triplets, vectors, keep)
    assert Counter(map(tuple, fused.collect())) == Counter(map(tuple, ev.triplet_scores(joined, keep).collect()))
    runs = {"whole": None, "cut": 2}
    by_run = ev.score_triplets(triplets, vectors, keep, runs)
    assert Counter(map(tuple, by_run.collect())) == Counter(map(tuple, ev.prefix_scores(joined, runs, keep).collect()))
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    # The positive's similarity is projected below the join with the negative.
    assert plan.index("__p#") < plan.rindex("Join") and not [x for x in plan.split("\n") if "p_vec" in x and "n_vec" in x]
    assert ev.score_triplets(triplets.limit(0), vectors, keep).count() == 0

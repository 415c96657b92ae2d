"""The registered operator queries and the pipeline on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from embedlake.llm import queries
from oracle import connect, differences
from test_llm_ops import brute_groups, brute_lines, brute_repetition, brute_windows, norm

FOLDER = os.environ.get("EMBEDLAKE_TEST_DATA", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}


# Columns that each query has at least, with their types.
COLUMNS = {
    "op2": "page_id bigint, host string, path string, rule string, verdict string",
    "op3": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean",
    "op8": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op9": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op13": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string",
}


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, name):
    frame = queries.queries()[name](spark, FOLDER)
    wanted = COLUMNS.get(name.split("_")[0])
    assert not wanted or set(tuple(c.split()) for c in wanted.split(", ")) <= set(frame.dtypes)
    if name in SQL:
        assert differences(frame, connect(FOLDER), SQL[name]) == []
    else:
        assert frame.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = docs.collect()
    for (name, stage), check in zip(corpus_pipeline.STAGES, [rules, lines, groups, windows, None]):
        out = stage(spark, docs, FOLDER)
        got = out.collect()
        if check:
            assert out.columns == docs.columns
            assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(check(spark, [(r["doc_id"], r["text"]) for r in held])), name
            docs, held = spark.createDataFrame(got, docs.schema), got
        else:
            tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
            assert sum(r["length"] for r in got) == sum(tokens.values())
            assert set(tokens) == {r["doc_id"] for r in held}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(got)


def rules(spark, rows):
    return [r for r in rows if brute_repetition(r[1])[-1]]


def lines(spark, rows):
    gone, _ = brute_lines(rows)
    out = []
    for key, text in rows:
        rest = [x for i, x in enumerate(text.split("\n")) if i not in gone.get((key, text), [])]
        if any(norm(x) for x in rest):
            out.append((key, "\n".join(rest)))
    return out


def groups(spark, rows):
    first = {c for _, _, c in brute_groups(rows)}
    return [r for r in rows if r[0] in first]


def windows(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    return [r for r in rows if not brute_windows(r[1], items)[1]]

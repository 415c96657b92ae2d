"""Registered queries of the numbered operators, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from embedlake.llm import (
    conversation_repair,
    decontaminate,
    filter_audit,
    frames,
    fuzzy_lines,
    length_histogram,
    link_trust,
    ngram_join,
    packing,
    pii,
    repetition,
    secrets,
    warc,
)
from embedlake.session import tune

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        _queries[run.__name__] = lambda spark, folder: run(tune(spark), folder)
        if sql is not None:
            _sql[run.__name__] = sql
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counts = length_histogram.length_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return length_histogram.histogram(counts)


@query()
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    listed = frames.write(docs, frames.new_folder(spark), public_tokenizers.path("word_bpe_49k.json"))
    return frames.read(listed)


FOLLOWING = ", ".join(f"lead(word, {j}) OVER v AS w{j}" for j in range(1, 10))


@query(
    rf"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), words AS (
      SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
    ), chars AS (SELECT r, sum(length(word)) AS word_chars FROM words GROUP BY r),
    following AS (
      SELECT r, p, word, {FOLLOWING} FROM words WINDOW v AS (PARTITION BY r ORDER BY p)
    ), windows AS (
      SELECT r, k, i, count(*) OVER (PARTITION BY r, k, s) > 1 AS again
      FROM (SELECT r, 5 AS k, p AS i, concat_ws(' ', word, w1, w2, w3, w4) AS s FROM following WHERE w4 IS NOT NULL
            UNION ALL SELECT r, 7, p, concat_ws(' ', word, w1, w2, w3, w4, w5, w6) FROM following WHERE w6 IS NOT NULL
            UNION ALL SELECT r, 10, p, concat_ws(' ', word, w1, w2, w3, w4, w5, w6, w7, w8, w9) FROM following WHERE w9 IS NOT NULL)
    ), covered AS (
      SELECT r, k, count(*) AS n, sum(length(word)) AS c
      FROM (SELECT DISTINCT r, k, unnest(range(i, i + k)) AS p FROM windows WHERE again) JOIN words USING (r, p) GROUP BY r, k
    ), grams AS (
      SELECT r, max(n) FILTER (k = 5) AS n5, max(c) FILTER (k = 5) AS c5, max(c) FILTER (k = 7) AS c7,
             max(c) FILTER (k = 10) AS c10 FROM covered GROUP BY r
    ), lines AS (
      SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY place) > 1 AS again
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS place FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ), dups AS (
      SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS c FROM lines WHERE again GROUP BY r
    ), facts AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(n5, 0)::BIGINT AS n_repeat_words,
             coalesce(dups.c, 0)::DOUBLE / greatest(word_chars, 1) AS l, coalesce(c5, 0)::DOUBLE / greatest(word_chars, 1) AS s5,
             coalesce(c7, 0)::DOUBLE / greatest(word_chars, 1) AS s7, coalesce(c10, 0)::DOUBLE / greatest(word_chars, 1) AS s10
      FROM d LEFT JOIN chars USING (r) LEFT JOIN grams USING (r) LEFT JOIN dups USING (r)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(l, 6) AS dup_line_share,
           round(s5, 6) AS dup_share_5, round(s7, 6) AS dup_share_7, round(s10, 6) AS dup_share_10,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR l > 0.30 OR s5 > 0.20 OR s7 > 0.17 OR s10 > 0.14) AS kept
    FROM facts
    """
)
def op7_repetition(spark: SparkSession, folder: str) -> DataFrame:
    found = repetition.repetition(table(spark, folder, "documents"))
    shares = [F.round(F.col("dup_gram_shares")[i], 6).alias(f"dup_share_{n}") for i, n in enumerate(sorted(repetition.GRAM_SHARES))]
    return found.withColumn("dup_line_share", F.round("dup_line_share", 6)).select("*", *shares).drop("dup_gram_shares")


def _digest(spans: DataFrame, base: list[str], by_kind: bool) -> DataFrame:
    """Counts, hash of the base spans and all spans as text, from span arrays."""
    order = F.array(*[F.lit(k) for k in base])
    place = lambda s: F.array_position(order, s["kind"])  # noqa: E731
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))  # noqa: E731

    def keyed(items):
        number = lambda s: F.when(place(s) > 0, place(s)).otherwise(F.lit(99)).cast("long")  # noqa: E731
        pairs = F.transform(
            items,
            lambda s: F.struct(
                (number(s) if by_kind else s["start"]).alias("a"),
                (s["start"] if by_kind else number(s)).alias("b"),
                line(s).alias("line"),
            ),
        )
        return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["line"]), ",")

    only = F.filter("spans", lambda s: F.array_contains(order, s["kind"]))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    return spans.select("doc_id", *counts, F.sha2(keyed(only), 256).alias("base_sha256"), keyed(F.col("spans")).alias("spans"))


@query()
def op8_secret_formats(spark: SparkSession, folder: str) -> DataFrame:
    spans = secrets.scan(table(spark, folder, "documents"))
    return _digest(spans, ["assign", "access", "hex"], by_kind=False)


@query()
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(pii.scan(table(spark, folder, "documents")), pii.BASE, by_kind=True)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    rf"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), b AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL
    ), bw AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
    ), dw AS (
      SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
            FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
    ), hits AS (
      SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s
    ), words AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
    ), items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """
)
def op3_benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    rf"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    pairs AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
      SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
    ), reached AS (
      SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM reached r JOIN links l ON l.a = r.doc_id
    )
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM reached r WHERE r.doc_id = d.doc_id) AS component_id
    FROM d LEFT JOIN sizes USING (doc_id)
    """
)
def op4_ngram_groups(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query()
def op2_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    return link_trust.judge(table(spark, folder, "pages"), RULES)


@query()
def op5_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    gone = fuzzy_lines.repeated_lines(docs)
    filled = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(filled).alias("print"), F.size(F.split(filled, "\n")).cast("long").alias("n_lines"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print"), "dropped")
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("print") == F.col("gone_print")), "left")
    return joined.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped_lines"),
    )


@query(
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), l AS (
      SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
      FROM labels GROUP BY doc_id
    ), f AS (
      SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
             CAST(len(w) < 200 AS INT)
             + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
             + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
             + 16 * CAST(coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false) AS INT) AS mask
      FROM d LEFT JOIN l USING (doc_id)
    ), c AS (
      SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY part, mask
    ), letters AS (
      SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
    ), orders AS (
      SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
      FROM letters p, letters q, letters r, letters s, letters u
      WHERE p.b + q.b + r.b + s.b + u.b = 31 AND p.b & q.b = 0 AND p.b & r.b = 0 AND p.b & s.b = 0 AND p.b & u.b = 0
        AND q.b & r.b = 0 AND q.b & s.b = 0 AND q.b & u.b = 0 AND r.b & s.b = 0 AND r.b & u.b = 0 AND s.b & u.b = 0
    ), steps AS (
      SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, list_sum(bits[1 : step]) - bits[step] AS before
      FROM orders, (SELECT unnest(range(1, 6)) AS step)
    )
    SELECT part, filter_order, step,
           CAST(coalesce(sum(n) FILTER (mask & (before + bit)::INT = 0), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before::INT = 0), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before::INT > 0), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before::INT = 0), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before::INT = 0), 0) AS BIGINT) AS toxic_lost,
           CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0) AS BIGINT) AS shapley
    FROM c, steps GROUP BY part, filter_order, step
    """
)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS h,
             row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
      FROM pages
    )
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
           CASE WHEN strlen(h) >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN strlen(h) >= 100 AND place > 1 THEN first END AS refers_to
    FROM p
    """
)
def op12_revisits(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    kind = dict(pages.dtypes)["page_id"]
    found = warc.archived_pages(pages)
    return found.select(
        F.col("page_id").cast(kind),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_page").cast(kind).alias("refers_to"),
    )


@query(
    r"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             [ascii(c)::BIGINT FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS codes
      FROM conversations
    ), crc AS (
      SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, codes), lambda c, b:
               list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i:
                 xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS kind
      FROM keyed
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM crc, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0
    ), placed AS (
      SELECT *, coalesce(conv_id::VARCHAR, 'null') AS conv,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged
    ), faulty AS (
      SELECT *, left(role, 1) AS letter, rtrim(text, E' 	

') AS shown,
             row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS again,
             lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY n) AS before FROM placed
    ), rows_ AS (
      SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN again THEN 'duplicate'
                     WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM faulty
    ), stats AS (
      SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
             count_if(fault = 'truncated') AS truncated,
             count_if(before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
      FROM rows_ GROUP BY conv
    ), inserted(p, q, k) AS (
      VALUES ('n', 'n', 0), ('n', 'u', 1), ('n', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2),
             ('u', 'u', 0), ('u', 'a', 1), ('a', 'a', 0), ('a', 'u', 1)
    ), moves(edit, p, takes, q, price) AS (
      VALUES ('D', 'n', NULL, 'n', 4), ('D', 's', NULL, 's', 4), ('D', 'u', NULL, 'u', 4), ('D', 'a', NULL, 'a', 4),
             ('R', 'n', NULL, 'u', 3), ('R', 's', NULL, 'u', 3), ('R', 'u', NULL, 'a', 3), ('R', 'a', NULL, 'u', 3),
             ('K', 'n', 's', 's', 0), ('K', 'n', 'u', 'u', 0), ('K', 's', 'u', 'u', 0), ('K', 'u', 'a', 'a', 0), ('K', 'a', 'u', 'u', 0)
    ), best AS (
      SELECT conv, 0::BIGINT AS i, 'n' AS q, '000000000' AS v FROM stats
      UNION ALL
      SELECT b.conv, r.n, m.q,
             min(lpad((left(b.v, 9)::BIGINT + 3 * s.k + m.price
                       + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 9, '0')
                 || b.v[10:] || repeat('I', s.k) || m.edit)
      FROM best b JOIN rows_ r ON r.conv = b.conv AND r.n = b.i + 1
      JOIN inserted s ON s.p = b.q JOIN moves m ON m.p = s.q
      WHERE (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (m.takes IS NULL OR m.takes = r.letter)
      GROUP BY b.conv, r.n, m.q
    ), solved AS (
      SELECT b.conv, min(lpad((left(b.v, 9)::BIGINT + 3 * s.k)::VARCHAR, 9, '0') || b.v[10:] || repeat('I', s.k)) AS v
      FROM best b JOIN stats t ON t.conv = b.conv AND t.n = b.i JOIN inserted s ON s.p = b.q
      WHERE s.q IN ('n', 'a') GROUP BY b.conv
    ), edits AS (
      SELECT conv, j, v[9 + j] AS edit FROM solved, range(1, length(v) - 8) AS t(j)
    ), numbered AS (
      SELECT *, count_if(edit <> 'I') OVER w AS at, count_if(edit <> 'D') OVER w AS o
      FROM edits WINDOW w AS (PARTITION BY conv ORDER BY j)
    ), lined AS (
      SELECT e.conv, e.j, e.edit, e.o, r.role, CASE WHEN e.edit = 'I' THEN '' ELSE r.text END AS text,
             bool_or(e.o = 1 AND e.edit = 'K' AND r.letter = 's') OVER (PARTITION BY e.conv) AS opened
      FROM numbered e LEFT JOIN rows_ r ON r.conv = e.conv AND r.n = e.at AND e.edit <> 'I' WHERE e.edit <> 'D'
    ), texts AS (
      SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                              || ':' || text, chr(10) ORDER BY j) AS repaired FROM lined GROUP BY conv
    )
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(v, 9)::BIGINT, 0) AS cost, coalesce(v[10:], '') AS audit,
           sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS conv FROM conversations) c
    LEFT JOIN stats USING (conv) LEFT JOIN solved USING (conv) LEFT JOIN texts USING (conv)
    """
)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repaired_conversations(table(spark, folder, "conversations"))

"""Vector scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.functions.vectors import prefix
from embedlake.operators import encoder, evaluation as ev
from embedlake.plans.catalog import query
from embedlake.plans.tables import Tables, vector_triplets
from embedlake.session import cut_lineage

BASELINE_DIMENSIONS = 16

TRIPLETS_SQL = """
ids AS (
  SELECT vec_id, label, embedding,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n
  FROM embeddings),
triplets AS (
  SELECT q.vec_id AS q_id, q.label, q.embedding AS qv, p.embedding AS pv, x.embedding AS nv
  FROM ids q
  JOIN ids p ON p.label = q.label AND p.n = q.n + 1
  JOIN ids x ON x.label = (q.label + 1) % 10 AND x.n = q.n)"""

_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _scores_sql(name: str, cut: str = "{}") -> str:
    q, p, n = (cut.format(v) for v in ("qv", "pv", "nv"))
    return f"""
{name} AS (
  SELECT q_id, label, {_COS.format(a=q, b=p)} AS pos_sim, {_COS.format(a=q, b=n)} AS neg_sim
  FROM triplets)"""


def _metrics_sql(name: str, scores: str) -> str:
    return f"""
{name}_sides AS (
  SELECT 1.0::DOUBLE AS y, round(pos_sim, 9) AS s FROM {scores}
  UNION ALL SELECT 0.0::DOUBLE, round(neg_sim, 9) FROM {scores}),
{name}_ranks AS (
  SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM {name}_sides),
{name} AS (
  SELECT avg(pos_sim) AS avg_positive_similarity, avg(neg_sim) AS avg_negative_similarity,
         CASE WHEN avg(neg_sim) > 0 THEN avg(pos_sim) / avg(neg_sim)
              ELSE 'Infinity'::DOUBLE END AS similarity_ratio,
         (SELECT coalesce(corr(ry, r), 0.0) FROM {name}_ranks) AS spearman_correlation,
         count(*) AS num_samples
  FROM {scores})"""


_ROUNDED = """round(avg_positive_similarity, 6) + 0.0 AS avg_positive_similarity,
  round(avg_negative_similarity, 6) + 0.0 AS avg_negative_similarity,
  round(similarity_ratio, 6) AS similarity_ratio,
  round(spearman_correlation, 6) + 0.0 AS spearman_correlation, num_samples"""


def scores(t: Tables, dimensions: int | None = None) -> DataFrame:
    return ev.score_triplets(vector_triplets(t), t.embeddings, ["q_id", "label"], dimensions=dimensions)


def rounded(df: DataFrame, *names: str, decimals: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), decimals) + F.lit(0.0) for n in names})


def rounded_metrics(df: DataFrame) -> DataFrame:
    return rounded(df, *ev.METRICS[:4])


def both_models(t: Tables) -> DataFrame:
    """Metrics of the full vectors (trained) and of their prefix (baseline)."""
    runs = {"trained": None, "baseline": BASELINE_DIMENSIONS}
    return ev.evaluate(ev.score_triplets(vector_triplets(t), t.embeddings, (), runs), ["model"])


_BOTH_SQL = (
    f"WITH {TRIPLETS_SQL},{_scores_sql('full_scores')},"
    f"{_scores_sql('short_scores', '{}[1:16]')},"
    f"{_metrics_sql('trained', 'full_scores')},{_metrics_sql('baseline', 'short_scores')}"
)


@query(
    f"WITH {TRIPLETS_SQL},{_scores_sql('scores')},{_metrics_sql('metrics', 'scores')} "
    f"SELECT {_ROUNDED}, similarity_ratio >= 0 AND num_samples > 0 AS valid FROM metrics"
)
def evaluate_triplets(t: Tables) -> DataFrame:
    return rounded_metrics(ev.evaluate(scores(t)))


@query(
    f"WITH {TRIPLETS_SQL},{_scores_sql('scores')} SELECT q_id, "
    "round(pos_sim, 6) + 0.0 AS pos_sim, round(neg_sim, 6) + 0.0 AS neg_sim FROM scores"
)
def cosine_pairs(t: Tables) -> DataFrame:
    return rounded(scores(t).select("q_id", "pos_sim", "neg_sim"), "pos_sim", "neg_sim")


@query(
    f"""WITH {TRIPLETS_SQL},{_scores_sql('scores')},
sides AS (SELECT 1 AS y, round(pos_sim, 9) + 0.0 AS s FROM scores
          UNION ALL SELECT 0, round(neg_sim, 9) + 0.0 FROM scores)
SELECT round(s, 6) + 0.0 AS score, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
       sum(count(*)) OVER (ORDER BY s)::DOUBLE - (count(*) - 1) / 2.0 AS avg_rank
FROM sides GROUP BY s"""
)
def spearman_rank(t: Tables) -> DataFrame:
    ranks = ev.score_ranks(scores(t)).select("score", "n_pos", "n_neg", "avg_rank")
    return rounded(ranks, "score")


@query(
    f"""{_BOTH_SQL}
SELECT {", ".join(f"round(t.{m}, 6) + 0.0 AS trained_{m}" for m in ev.METRICS[:4])},
  t.num_samples AS trained_num_samples,
  {", ".join(f"round(b.{m}, 6) + 0.0 AS baseline_{m}" for m in ev.METRICS[:4])},
  b.num_samples AS baseline_num_samples,
  round(t.avg_positive_similarity - b.avg_positive_similarity, 6) + 0.0
    AS positive_similarity_improvement,
  round(t.avg_negative_similarity - b.avg_negative_similarity, 6) + 0.0
    AS negative_similarity_improvement,
  CASE WHEN isinf(t.similarity_ratio) AND isinf(b.similarity_ratio) THEN NULL
       ELSE round(t.similarity_ratio - b.similarity_ratio, 6) END AS ratio_improvement,
  round(t.spearman_correlation - b.spearman_correlation, 6) + 0.0 AS correlation_improvement
FROM trained t, baseline b"""
)
def compare_models(t: Tables) -> DataFrame:
    compared = ev.compare(both_models(t))
    counts = {"trained_num_samples", "baseline_num_samples"}
    return rounded(compared, *[c for c in compared.columns if c not in counts])


@query(
    f"""{_BOTH_SQL}
SELECT 'trained' AS model, {_ROUNDED}, NULL::DOUBLE AS broken FROM trained
UNION ALL SELECT 'baseline', {_ROUNDED}, NULL::DOUBLE FROM baseline"""
)
def metrics_json(t: Tables) -> DataFrame:
    """Metrics written as JSON and read back; broken JSON decodes to null."""
    stored = ev.to_json(rounded_metrics(both_models(t))).select(
        "model", "metrics_json", F.expr("left(metrics_json, 40)").alias("cut_json")
    )
    decoded = ev.from_json(ev.from_json(stored), "cut_json", "cut")
    return decoded.select(
        "model", "metrics.*", F.col("cut.similarity_ratio").alias("broken")
    )




@query(
    f"""{_BOTH_SQL},
both_runs AS (SELECT 'trained' AS model, * FROM trained UNION ALL SELECT 'baseline', * FROM baseline)
SELECT model, num_samples AS samples_evaluated,
  printf('%.4f', avg_positive_similarity) AS positive_avg,
  printf('%.4f', avg_negative_similarity) AS negative_avg,
  CASE WHEN isinf(similarity_ratio) THEN 'inf' ELSE printf('%.4f', similarity_ratio) END AS ratio,
  printf('%.4f', spearman_correlation) AS correlation,
  'Positive similarity: ' || printf('%.3f', avg_positive_similarity)
  || ', Negative similarity: ' || printf('%.3f', avg_negative_similarity)
  || ', Ratio: ' || CASE WHEN isinf(similarity_ratio) THEN 'inf'
                         ELSE printf('%.3f', similarity_ratio) END AS summary
FROM both_runs"""
)
def evaluation_summary(t: Tables) -> DataFrame:
    return ev.summaries(both_models(t), ["model"])


@query(
    f"""{_BOTH_SQL}
SELECT 'Similarity ratio improved by '
  || CASE WHEN isinf(t.similarity_ratio) AND isinf(b.similarity_ratio) THEN 'nan'
          WHEN isinf(t.similarity_ratio) THEN 'inf'
          WHEN isinf(b.similarity_ratio) THEN '-inf'
          ELSE printf('%.3f', t.similarity_ratio - b.similarity_ratio) END
  || ' (' || CASE WHEN isinf(b.similarity_ratio) THEN 'inf' ELSE printf('%.3f', b.similarity_ratio) END
  || ' → ' || CASE WHEN isinf(t.similarity_ratio) THEN 'inf' ELSE printf('%.3f', t.similarity_ratio) END
  || ')' AS summary
FROM trained t, baseline b"""
)
def improvement_summary(t: Tables) -> DataFrame:
    return ev.compare(both_models(t)).select(ev.improvement_line().alias("summary"))


@query(
    f"""WITH {TRIPLETS_SQL},{_scores_sql('scores')},
pairs AS (SELECT label AS q_label, pos_sim AS c, 1.0::DOUBLE AS y FROM scores
          UNION ALL SELECT label, neg_sim, -1.0::DOUBLE FROM scores)
SELECT q_label, count(*) AS n_pairs, round(avg((c - y) * (c - y)), 6) AS loss
FROM pairs GROUP BY q_label"""
)
def pair_loss(t: Tables) -> DataFrame:
    pairs = ev.labelled_scores(scores(t).withColumnRenamed("label", "q_label"), ["q_label"])
    return rounded(ev.pair_loss(pairs, ["q_label"]), "loss")


@query(
    """SELECT vec_id, (i - 1)::INTEGER AS dim, round(embedding[i]::DOUBLE, 6) + 0.0 AS value
FROM embeddings, range(1, 17) r(i)"""
)
def embedding_prefix(t: Tables) -> DataFrame:
    short = prefix(F.col("embedding"), BASELINE_DIMENSIONS)
    rows = t.embeddings.select("vec_id", F.posexplode(short).alias("dim", "raw"))
    return rows.select(
        "vec_id", "dim", (F.round(F.col("raw").cast("double"), 6) + F.lit(0.0)).alias("value")
    )


@query(
    """WITH cells AS (
  SELECT label, i, embedding[i]::DOUBLE AS h,
         CASE WHEN embedding[1] > -0.2 THEN 1 ELSE 0 END AS m
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
SELECT label, (i - 1)::INTEGER AS dim, count(*) AS n_tokens,
       round(sum(h * m) / sum(m), 6) + 0.0 AS value
FROM cells GROUP BY label, i"""
)
def mean_pool(t: Tables) -> DataFrame:
    """Rows of a label act as the tokens of one text."""
    mask = F.when(F.col("embedding")[0] > -0.2, 1).otherwise(0)
    pooled = encoder.mean_pool(t.embeddings.withColumn("mask", mask), ["label"])
    rows = pooled.select("label", "n_tokens", F.posexplode("embedding").alias("dim", "value"))
    return rounded(rows, "value")


@query(
    f"""WITH {TRIPLETS_SQL}
SELECT q_id FROM triplets ORDER BY md5('42:' || q_id), q_id LIMIT 250"""
)
def eval_sample(t: Tables) -> DataFrame:
    """The sampling operator: exactly 250 triplets, seeded."""
    return ev.sample(cut_lineage(vector_triplets(t).select("q_id")), 250)


@query(
    r"""WITH counted AS (
  SELECT source, lang, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS n FROM documents)
SELECT source, lang, count(*) AS n_inputs, sum(least(n, 128))::BIGINT AS prompt_tokens,
       sum(n)::BIGINT AS untruncated_tokens
FROM counted GROUP BY source, lang"""
)
def token_usage(t: Tables) -> DataFrame:
    return encoder.token_usage(t.documents, "text", ["source", "lang"])


@query(
    """WITH cells AS (
  SELECT label, i, list_concat(embedding, embedding)[i]::DOUBLE AS h, vec_id % 3 AS m
  FROM (SELECT *, unnest(range(1, 2 * len(embedding) + 1)) AS i FROM embeddings))
SELECT label, (i - 1)::INTEGER AS dim, count(*) AS n_tokens,
       round(sum(h * m) / sum(m), 6) + 0.0 AS value
FROM cells GROUP BY label, i"""
)
def mean_pool_wide(t: Tables) -> DataFrame:
    """Vectors twice as long; the length comes from the data."""
    wide = t.embeddings.select(
        "label", F.concat("embedding", "embedding").alias("embedding"), (F.col("vec_id") % 3).alias("mask")
    )
    pooled = encoder.mean_pool(wide, ["label"])
    rows = pooled.select("label", "n_tokens", F.posexplode("embedding").alias("dim", "value"))
    return rounded(rows, "value")


@query(
    r"""WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+')[1:128] AS items FROM documents)
SELECT 'text' AS kind, doc_id, len(items)::BIGINT AS n_tokens, md5(array_to_string(items, ' ')) AS tokens_md5 FROM cut
UNION ALL
SELECT 'ids', vec_id, len(embedding)::BIGINT,
       md5(array_to_string([floor(x * 1000)::BIGINT FOR x IN embedding], ' ')) FROM embeddings""".replace("\\\\", "\\")
)
def token_prefix(t: Tables) -> DataFrame:
    """The tokens a model is given: 128 of a text, all of a list of ids."""
    texts = encoder.token_prefix(t.documents.select(F.col("doc_id"), "text"), "text")
    ids = t.embeddings.select(
        F.col("vec_id").alias("doc_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("ids"),
    )
    ids = encoder.token_prefix(ids, "ids")
    shown = ["doc_id", "n_tokens", F.md5("tokens_text").alias("tokens_md5")]
    return texts.select(F.lit("text").alias("kind"), *shown).unionByName(
        ids.select(F.lit("ids").alias("kind"), *shown)
    )


@query(
    f"""WITH {TRIPLETS_SQL},{_scores_sql('all_scores')},
scores AS (SELECT q_id, label, CASE WHEN q_id % 7 <> 0 THEN pos_sim END AS pos_sim,
                  CASE WHEN q_id % 7 <> 0 THEN neg_sim END AS neg_sim FROM all_scores)
SELECT label, count(*) AS num_triplets, count(*) FILTER (pos_sim IS NULL OR neg_sim IS NULL) AS num_unscored,
       round(avg(pos_sim), 6) + 0.0 AS avg_positive_similarity
FROM scores GROUP BY label"""
)
def evaluate_missing_vectors(t: Tables) -> DataFrame:
    """Every seventh question has no vector; no triplet is lost."""
    triplets = vector_triplets(t).withColumn("q_id", F.when(F.col("q_id") % 7 == 0, -F.col("q_id") - 1).otherwise(F.col("q_id")))
    scored = ev.score_triplets(triplets, t.embeddings, ["q_id", "label"])
    means = ev.scored_only(scored).groupBy("label").agg(F.avg("pos_sim").alias("avg_positive_similarity"))
    return rounded(ev.unscored(scored, ["label"]).join(means, "label", "left"), "avg_positive_similarity")

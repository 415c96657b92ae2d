"""Scoring embeddings on question, positive and negative triplets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.functions.vectors import cosine, prefix, squared_norm
from embedlake.operators.ranking import exact_sample, running_total
from embedlake.session import cut_lineage

METRICS = [
    "avg_positive_similarity",
    "avg_negative_similarity",
    "similarity_ratio",
    "spearman_correlation",
    "num_samples",
]

# Scores are compared at nine decimals, so a group holds at most 2 * 10^9 + 1
# distinct scores and one of 65,537 cells at most 30,518 of them.
SCORE_DECIMALS = 9
SCORE_CELLS = 32_768


def attach_vectors(
    triplets: DataFrame,
    vectors: DataFrame,
    dimensions: int | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Join ``q_id, p_id, n_id`` with their vectors and squared norms.

    Norms are computed once per vector, before the rows fan out. Popular
    vectors make hot join keys; AQE splits those. A triplet whose vector is
    missing stays, with nulls.
    """
    sized = _sized(vectors, dimensions, id_column, vector_column)
    out = triplets
    for role in ("q", "p", "n"):
        out = _with_role(out, sized, role)
    return out


def _sized(vectors: DataFrame, dimensions: int | None, id_column: str, vector_column: str) -> DataFrame:
    values = prefix(F.col(vector_column), dimensions)
    found = vectors.select(F.col(id_column).alias("__id"), values.alias("__v"))
    return found.withColumn("__sq", squared_norm(F.col("__v")))


def _with_role(rows: DataFrame, sized: DataFrame, role: str) -> DataFrame:
    side = sized.select(
        F.col("__id").alias(f"{role}_id"),
        F.col("__v").alias(f"{role}_vec"),
        F.col("__sq").alias(f"{role}_sq"),
    )
    return rows.join(side, f"{role}_id", "left")


def score_triplets(
    triplets: DataFrame,
    vectors: DataFrame,
    keep: Sequence[str] = ("q_id",),
    runs: Mapping[str, int | None] | None = None,
    dimensions: int | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Scores of ``q_id, p_id, n_id`` without rows of three vectors.

    The positive's vector gives way to its similarities before the negative is
    joined, so only the question's vector moves on, once per further join. With
    ``runs`` every triplet has one row per ``model``, see ``prefix_scores``.
    """
    models = runs or {"": None}
    sized = _sized(vectors, dimensions, id_column, vector_column)
    rows = _with_role(triplets, sized, "q")
    for role in ("p", "n"):
        rows = _with_role(rows, sized, role)
        found = F.array(*[_similarity(role, d) for d in models.values()])
        rows = rows.withColumn(f"__{role}", found).drop(f"{role}_vec", f"{role}_sq")
    if runs is None:
        return rows.select(*keep, F.col("__p")[0].alias("pos_sim"), F.col("__n")[0].alias("neg_sim"))
    each = [
        F.struct(F.lit(m).alias("model"), F.col("__p")[i].alias("pos_sim"), F.col("__n")[i].alias("neg_sim"))
        for i, m in enumerate(runs)
    ]
    return rows.select(*keep, F.inline(F.array(*each)))


def unscored(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Triplets, and those without a score: a vector is missing or unequally long."""
    lost = F.col("pos_sim").isNull() | F.col("neg_sim").isNull()
    return scores.groupBy(*by).agg(
        F.count("*").alias("num_triplets"), F.count_if(lost).alias("num_unscored")
    )


def scored_only(scores: DataFrame, strict: bool = False) -> DataFrame:
    """Triplets with both scores; ``strict`` fails the job at the first other one."""
    whole = F.col("pos_sim").isNotNull() & F.col("neg_sim").isNotNull()
    if strict:
        lost = F.raise_error(F.lit("triplet with a missing or unequally long vector"))
        return scores.withColumn("pos_sim", F.when(whole, F.col("pos_sim")).otherwise(lost.cast("double")))
    return scores.filter(whole)


def triplet_scores(scored: DataFrame, keep: Sequence[str] = ("q_id",)) -> DataFrame:
    """Row-wise positive and negative similarity, no pair matrix."""
    return scored.select(
        *keep,
        cosine(F.col("q_vec"), F.col("p_vec"), F.col("q_sq"), F.col("p_sq")).alias("pos_sim"),
        cosine(F.col("q_vec"), F.col("n_vec"), F.col("q_sq"), F.col("n_sq")).alias("neg_sim"),
    )


def _similarity(other: str, dimensions: int | None) -> Column:
    if dimensions is None:
        return cosine(F.col("q_vec"), F.col(f"{other}_vec"), F.col("q_sq"), F.col(f"{other}_sq"))
    return cosine(prefix(F.col("q_vec"), dimensions), prefix(F.col(f"{other}_vec"), dimensions))


def prefix_scores(
    scored: DataFrame, runs: Mapping[str, int | None], keep: Sequence[str] = ()
) -> DataFrame:
    """Scores of several models that are prefixes of the same vectors.

    The vectors are joined once; every run of ``name -> dimensions`` adds a row.
    """

    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                _similarity("p", d).alias("pos_sim"),
                _similarity("n", d).alias("neg_sim"),
            )
            for name, d in runs.items()
        ]
    )
    return scored.select(*keep, F.inline(rows))


def score_ranks(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct score among positives and negatives."""
    by = list(by)
    sides = F.explode(
        F.array(
            F.struct(F.col("pos_sim").alias("raw"), F.lit(1).alias("is_pos")),
            F.struct(F.col("neg_sim").alias("raw"), F.lit(0).alias("is_pos")),
        )
    )
    score = F.round(F.col("side.raw"), SCORE_DECIMALS) + F.lit(0.0)
    positive = F.col("side.is_pos") == 1
    distinct = (
        scores.select(*by, sides.alias("side"))
        .withColumn("score", score)
        .groupBy(*by, "score")
        .agg(
            F.count_if(positive).alias("n_pos"),
            F.count_if(~positive).alias("n_neg"),
            F.coalesce(F.sum(F.when(positive, F.col("side.raw"))), F.lit(0.0)).alias("sum_pos"),
            F.coalesce(F.sum(F.when(~positive, F.col("side.raw"))), F.lit(0.0)).alias("sum_neg"),
        )
    )
    # Ranking reads the distinct scores twice; the vector joins run once.
    distinct = cut_lineage(distinct)
    ties = F.col("n_pos") + F.col("n_neg")
    placed = running_total(
        distinct, ties, [F.col("score")], [F.floor(F.col("score") * SCORE_CELLS)], by
    )
    return placed.withColumn("avg_rank", F.col("before") + (ties + 1) / F.lit(2.0)).drop("before")


def evaluate(scores: DataFrame, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Averages, ratio, Spearman correlation and count from one score pass.

    Triplets without both scores are left out of the metrics (``unscored``
    counts them), or fail the job if ``strict``.
    """
    scores = scored_only(scores, strict)
    ties = F.col("n_pos") + F.col("n_neg")
    rank = F.col("avg_rank")
    sums = (
        score_ranks(scores, by)
        .groupBy(*by)
        .agg(
            F.sum("n_pos").alias("p"),
            F.sum("n_neg").alias("n"),
            F.sum("sum_pos").alias("sum_pos"),
            F.sum("sum_neg").alias("sum_neg"),
            F.count("*").alias("distinct_scores"),
            F.sum(F.col("n_pos") * rank).alias("rank_pos"),
            F.sum(ties * rank * rank).alias("rank_sq"),
        )
        .filter(F.col("p") > 0)
    )
    c = F.col
    half = F.lit(0.5)
    # Labels have two tied groups, so their ranks are known without sorting.
    # Each step is a projection of its own, which keeps the expressions small.
    ranks = sums.withColumns(
        {
            "total": (c("p") + c("n")).cast("double"),
            "mean_rank": (c("p") + c("n") + 1) * half,
            "label_pos": c("n") + (c("p") + 1) * half,
            "label_neg": (c("n") + 1) * half,
        }
    ).withColumns(
        {
            "rank_neg": c("total") * c("mean_rank") - c("rank_pos"),
            "mean_sq": c("total") * c("mean_rank") * c("mean_rank"),
            "gap_pos": c("label_pos") - c("mean_rank"),
            "gap_neg": c("label_neg") - c("mean_rank"),
        }
    )
    spread = (c("p") * c("gap_pos") * c("gap_pos") + c("n") * c("gap_neg") * c("gap_neg")) * (
        c("rank_sq") - c("mean_sq")
    )
    moments = ranks.select(
        *by,
        (c("sum_pos") / c("p")).alias("avg_positive_similarity"),
        (c("sum_neg") / c("n")).alias("avg_negative_similarity"),
        (c("rank_pos") * c("label_pos") + c("rank_neg") * c("label_neg") - c("mean_sq")).alias(
            "covariance"
        ),
        F.sqrt(spread).alias("spread"),
        "distinct_scores",
        c("p").alias("num_samples"),
    )
    correlation = F.when(c("distinct_scores") <= 1, F.lit(0.0)).otherwise(
        F.nanvl(F.coalesce(F.try_divide("covariance", "spread"), F.lit(0.0)), F.lit(0.0))
    )
    return moments.select(
        *by,
        "avg_positive_similarity",
        "avg_negative_similarity",
        similarity_ratio(c("avg_positive_similarity"), c("avg_negative_similarity")).alias(
            "similarity_ratio"
        ),
        correlation.alias("spearman_correlation"),
        "num_samples",
    ).withColumn("valid", metrics_valid())


def similarity_ratio(avg_pos: Column, avg_neg: Column) -> Column:
    return F.when(avg_neg > 0, F.try_divide(avg_pos, avg_neg)).otherwise(
        F.lit(float("inf"))
    )


def metrics_valid() -> Column:
    """The value ranges a metrics row has to keep."""
    within = lambda c: F.col(c).between(-1 - 1e-9, 1 + 1e-9)
    return (
        (F.col("num_samples") > 0)
        & within("avg_positive_similarity")
        & within("avg_negative_similarity")
        & (F.col("similarity_ratio") >= 0)
        & within("spearman_correlation")
    )


def compare(metrics: DataFrame, trained: str = "trained", baseline: str = "baseline") -> DataFrame:
    """Trained and baseline metrics side by side with their differences.

    ``metrics`` has one row per ``model``.
    """

    def of(model: str, metric: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(metric)))

    wide = metrics.agg(
        *[of(trained, m).alias(f"trained_{m}") for m in METRICS],
        *[of(baseline, m).alias(f"baseline_{m}") for m in METRICS],
    )
    gains = {
        "positive_similarity_improvement": "avg_positive_similarity",
        "negative_similarity_improvement": "avg_negative_similarity",
        "ratio_improvement": "similarity_ratio",
        "correlation_improvement": "spearman_correlation",
    }
    differences = {
        name: F.col(f"trained_{m}") - F.col(f"baseline_{m}") for name, m in gains.items()
    }
    # Two infinite ratios have no difference.
    return wide.withColumns(
        {name: F.when(~F.isnan(d), d) for name, d in differences.items()}
    )


def shown(value: Column, decimals: int) -> Column:
    """Fixed-decimal text with half-even ties; infinities as ``inf``, ``-inf``.

    A negative value keeps its sign when it rounds to zero.
    """
    text = F.format_string(f"%.{decimals}f", F.bround(F.abs(value), decimals))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.replace(text, F.lit("Infinity"), F.lit("inf")))


def summary_line(prefix_: str = "") -> Column:
    m = lambda name: shown(F.col(prefix_ + name), 3)
    return F.concat(
        F.lit("Positive similarity: "),
        m("avg_positive_similarity"),
        F.lit(", Negative similarity: "),
        m("avg_negative_similarity"),
        F.lit(", Ratio: "),
        m("similarity_ratio"),
    )


def improvement_line() -> Column:
    gain = F.coalesce(shown(F.col("ratio_improvement"), 3), F.lit("nan"))
    return F.concat(
        F.lit("Similarity ratio improved by "),
        gain,
        F.lit(" ("),
        shown(F.col("baseline_similarity_ratio"), 3),
        F.lit(" → "),
        shown(F.col("trained_similarity_ratio"), 3),
        F.lit(")"),
    )


def summaries(metrics: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Summary sentence and four-decimal texts of each metrics row."""
    return metrics.select(
        *keep,
        F.col("num_samples").alias("samples_evaluated"),
        shown(F.col("avg_positive_similarity"), 4).alias("positive_avg"),
        shown(F.col("avg_negative_similarity"), 4).alias("negative_avg"),
        shown(F.col("similarity_ratio"), 4).alias("ratio"),
        shown(F.col("spearman_correlation"), 4).alias("correlation"),
        summary_line().alias("summary"),
    )


METRICS_SCHEMA = (
    "avg_positive_similarity double, avg_negative_similarity double, "
    "similarity_ratio double, spearman_correlation double, num_samples bigint"
)


def to_json(metrics: DataFrame, name: str = "metrics_json") -> DataFrame:
    return metrics.withColumn(name, F.to_json(F.struct(*METRICS)))


def from_json(df: DataFrame, column: str = "metrics_json", name: str = "metrics") -> DataFrame:
    """Lenient decode: malformed JSON gives null, not an error."""
    parsed = F.from_json(
        column, METRICS_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )
    fields = [F.col(f"__parsed.{m}").alias(m) for m in METRICS]
    return (
        df.withColumn("__parsed", parsed)
        .withColumn(
            name,
            F.when(
                F.col("__parsed").isNotNull() & F.col("__parsed._bad").isNull(),
                F.struct(*fields),
            ),
        )
        .drop("__parsed")
    )


def pair_loss(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared distance between cosine and label over labelled pairs."""
    error = F.col("cosine") - F.col("label")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.avg(error * error).alias("loss")
    )


def labelled_scores(scores: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Two labelled cosines per scored triplet: +1 positive, -1 negative."""
    pairs = F.array(
        F.struct(F.col("pos_sim").alias("cosine"), F.lit(1.0).alias("label")),
        F.struct(F.col("neg_sim").alias("cosine"), F.lit(-1.0).alias("label")),
    )
    return scores.select(*keep, F.inline(pairs))


def sample(df: DataFrame, max_samples: int | None = 1000, seed: int = 42, key=("q_id",)) -> DataFrame:
    """At most ``max_samples`` rows, seeded and independent of row order."""
    return exact_sample(df, max_samples, key, seed) if max_samples else df

"""Training-pair queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.operators import training as tr
from embedlake.operators.canonical import require_valid, training_errors, validation_report
from embedlake.operators.ranking import radix_levels
from embedlake.plans.catalog import query
from embedlake.plans.tables import Tables, text_triplets

TEXT_TRIPLETS_SQL = """
text_triplets AS (
  SELECT q.conv_id, q.turn, q.text AS question, p.text AS positive, n.text AS negative,
         q.conv_id % 5 AS dataset
  FROM conversations q
  JOIN conversations p ON p.conv_id = q.conv_id AND p.turn = q.turn + 1 AND p.role = 'assistant'
  LEFT JOIN conversations n
    ON n.conv_id = q.conv_id + 1 AND n.turn = q.turn + 1 AND n.role = 'assistant'
  WHERE q.role = 'user')"""

USABLE_SQL = f"""{TEXT_TRIPLETS_SQL},
usable AS (
  SELECT * FROM text_triplets
  WHERE trim(question, E' \\n\\t\\r') <> '' AND trim(positive, E' \\n\\t\\r') <> ''
    AND trim(negative, E' \\n\\t\\r') <> '')"""

EXAMPLES_SQL = f"""{USABLE_SQL},
examples AS (
  SELECT conv_id, turn, dataset, 0 AS slot, trim(question, E' \\n\\t\\r') AS text_a,
         trim(positive, E' \\n\\t\\r') AS text_b, 1.0::DOUBLE AS label FROM usable
  UNION ALL
  SELECT conv_id, turn, dataset, 1, trim(question, E' \\n\\t\\r'),
         trim(negative, E' \\n\\t\\r'), -1.0::DOUBLE FROM usable)"""

SPLIT_SQL = f"""{EXAMPLES_SQL},
split AS (
  SELECT conv_id, turn, dataset, slot, label,
         row_number() OVER (PARTITION BY dataset ORDER BY conv_id, turn, slot) - 1 AS position,
         count(*) OVER (PARTITION BY dataset) AS n_examples
  FROM examples)"""

BATCH_SIZE = 8


@query(
    f"WITH {EXAMPLES_SQL} SELECT *, CASE WHEN dataset = 4 THEN 'validation' ELSE 'train' END "
    "AS role FROM examples"
)
def training_examples(t: Tables) -> DataFrame:
    examples = tr.training_examples(text_triplets(t), ["conv_id", "turn", "dataset"])
    return tr.mark_last_as_validation(examples, "dataset", F.lit(4))


def positions(t: Tables) -> DataFrame:
    keys = tr.usable_triplets(text_triplets(t)).select("conv_id", "turn", "dataset")
    levels = [*radix_levels(F.col("conv_id")), F.col("conv_id"), *radix_levels(F.col("turn"))]
    return tr.split_by_position(keys, ["dataset"], [F.col("conv_id"), F.col("turn")], levels)


@query(
    f"""WITH {SPLIT_SQL}
SELECT conv_id, turn, dataset, slot, position, n_examples,
       CASE WHEN position < floor(0.1::DOUBLE * n_examples) THEN 'validation' ELSE 'train' END AS split
FROM split"""
)
def train_val_split(t: Tables) -> DataFrame:
    return positions(t).select(
        "conv_id", "turn", "dataset", "slot", "position", "n_examples", "split"
    )


@query(
    f"""WITH {USABLE_SQL}
SELECT conv_id, turn, CASE WHEN left(md5(conv_id || ':' || turn), 8) < '1999999a' THEN 'validation'
  ELSE 'train' END AS split FROM usable"""
)
def train_val_hash_split(t: Tables) -> DataFrame:
    """The split for data too large to number."""
    keys = tr.usable_triplets(text_triplets(t)).select("conv_id", "turn")
    return tr.hash_split(keys, ["conv_id", "turn"])


@query(
    f"""WITH {SPLIT_SQL}
SELECT dataset, position // {BATCH_SIZE} AS batch_id, count(*) AS batch_rows,
       min(position) AS first_position, max(conv_id) AS last_conv
FROM split GROUP BY 1, 2"""
)
def batching(t: Tables) -> DataFrame:
    batches = tr.with_batches(positions(t), BATCH_SIZE)
    return batches.groupBy("dataset", "batch_id").agg(
        F.count("*").alias("batch_rows"),
        F.min("position").alias("first_position"),
        F.max("conv_id").alias("last_conv"),
    )


@query(
    f"""WITH {USABLE_SQL}, totals AS (
  SELECT a.dataset, count(*) AS total_samples,
         (SELECT count(*) * 2 FROM usable u WHERE u.dataset = a.dataset) AS total_examples
  FROM text_triplets a GROUP BY a.dataset)
SELECT dataset, total_samples, total_examples,
       floor(0.1::DOUBLE * total_examples)::BIGINT AS validation_examples,
       total_examples - floor(0.1::DOUBLE * total_examples)::BIGINT AS train_examples
FROM totals"""
)
def training_stats(t: Tables) -> DataFrame:
    return tr.training_stats(text_triplets(t), "dataset")


@query(
    """WITH runs AS (
  SELECT user_id AS run_id, count(*) AS n_samples, round(sum(value), 2) AS runtime_s,
         1 + user_id % 3 AS epochs FROM events GROUP BY user_id)
SELECT run_id, n_samples, epochs, ceil(n_samples / 8.0)::BIGINT * epochs AS total_steps,
       round(CASE WHEN runtime_s > 0 THEN n_samples / runtime_s ELSE 0 END, 6)
         AS train_samples_per_second,
       round(CASE WHEN runtime_s > 0 THEN ceil(n_samples / 8.0) * epochs / runtime_s ELSE 0 END, 6)
         AS train_steps_per_second
FROM runs"""
)
def training_throughput(t: Tables) -> DataFrame:
    runs = (
        t.events.groupBy(F.col("user_id").alias("run_id"))
        .agg(F.count("*").alias("n_samples"), F.round(F.sum("value"), 2).alias("runtime_s"))
        .withColumn("epochs", F.lit(1) + F.col("run_id") % 3)
        .withColumn("batch_size", F.lit(BATCH_SIZE))
    )
    rates = tr.throughput(runs).drop("batch_size", "runtime_s")
    names = ["train_samples_per_second", "train_steps_per_second"]
    return rates.withColumns({n: F.round(n, 6) for n in names})


@query(
    f"""WITH {TEXT_TRIPLETS_SQL}
SELECT conv_id, turn, question, positive, coalesce(negative, question) AS negative FROM text_triplets"""
)
def evaluation_triplets(t: Tables) -> DataFrame:
    """Triplets whose question stands in for a missing negative; an invalid row would fail the job."""
    whole = text_triplets(t).withColumn("negative", F.coalesce("negative", "question"))
    return require_valid(whole).select("conv_id", "turn", "question", "positive", "negative")


@query(
    f"""WITH {TEXT_TRIPLETS_SQL},
wanted AS (SELECT DISTINCT conv_id % 60 AS id FROM conversations),
stored AS (SELECT DISTINCT conv_id % 50 AS id FROM conversations),
rows_ AS (SELECT conv_id % 50 AS id, * FROM text_triplets WHERE conv_id % 50 <> 7),
report AS (
  SELECT id, count(*) FILTER (negative IS NULL) AS lost, count(*) AS n FROM rows_ GROUP BY id)
SELECT w.id, nullif(concat_ws('; ',
    CASE WHEN s.id IS NULL THEN 'dataset not found' END,
    CASE WHEN s.id % 9 = 0 THEN 'missing columns: positive, negative' END,
    CASE WHEN s.id IS NOT NULL AND n IS NULL THEN 'dataset is empty' END,
    CASE WHEN s.id IS NOT NULL AND lost > 0 THEN 'Column ''negative'' contains ' || lost || ' null values' END), '') AS error
FROM wanted w LEFT JOIN stored s USING (id) LEFT JOIN report r USING (id)"""
)
def training_dataset_check(t: Tables) -> DataFrame:
    """Unknown ids, missing columns and bad values of the wanted datasets together."""
    part = lambda n: (F.col("conv_id") % n).alias("id")
    whole = F.array(*map(F.lit, ["question", "positive", "negative"]))
    short = F.array(F.lit("question"), F.lit("extra"))
    stored = t.conversations.select(part(50)).distinct()
    stored = stored.withColumn("columns", F.when(F.col("id") % 9 == 0, short).otherwise(whole))
    rows = text_triplets(t).select(part(50), "question", "positive", "negative").filter("id <> 7")
    return training_errors(t.conversations.select(part(60)), stored, validation_report(rows, ["id"]))

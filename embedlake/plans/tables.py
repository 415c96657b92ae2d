"""Operator inputs derived from the benchmark tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.operators.ranking import radix_levels, row_position
from embedlake.operators.registry import minted_id

NOW = "timestamp_ntz'2024-01-31 00:00:00'"
TODAY = "date'2024-01-31'"


class Tables:
    """Reads of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def now() -> Column:
    return F.expr(NOW)


def vector_triplets(t: Tables) -> DataFrame:
    """``q_id, p_id, n_id, label``: the next vector of the label, and the one at
    the same place of the following label."""
    ids = row_position(
        t.embeddings.select("vec_id", "label"),
        [F.col("vec_id")],
        radix_levels(F.col("vec_id")),
        by=["label"],
    )
    # A vector is a question at its own place, the positive of the place before
    # and the negative of the preceding label: one shuffle brings them together.
    label, place = F.col("label"), F.col("position")
    roles = F.inline(
        F.array(
            F.struct(F.lit("q").alias("role"), label.alias("at_label"), place.alias("at")),
            F.struct(F.lit("p").alias("role"), label.alias("at_label"), (place - 1).alias("at")),
            F.struct(F.lit("n").alias("role"), ((label + 9) % 10).alias("at_label"), place.alias("at")),
        )
    )
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("vec_id")))
    return (
        ids.select("vec_id", roles)
        .groupBy(F.col("at_label").alias("label"), "at")
        .agg(of("q").alias("q_id"), of("p").alias("p_id"), of("n").alias("n_id"))
        .filter("q_id is not null and p_id is not null and n_id is not null")
        .select("q_id", "p_id", "n_id", "label")
    )


def text_triplets(t: Tables) -> DataFrame:
    """User turn, next assistant turn, and the same turn one conversation on."""
    turns = t.conversations
    question = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    answers = turns.filter("role = 'assistant'")
    positive = answers.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive")
    )
    negative = answers.select(
        (F.col("conv_id") - 1).alias("conv_id"),
        (F.col("turn") - 1).alias("turn"),
        F.col("text").alias("negative"),
    )
    keys = ["conv_id", "turn"]
    return (
        question.join(positive, keys)
        .join(negative, keys, "left")
        .withColumn("dataset", F.col("conv_id") % 5)
    )


def datasets(t: Tables) -> DataFrame:
    """Dataset registry."""
    source = F.element_at(F.array(*map(F.lit, "HLS")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").alias("version"),
        F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("ds_"), F.col("p_partkey").cast("string"), F.lit(".jsonl")).alias("file_name"),
        F.when(F.col("p_size") > 25, "T").otherwise("D").alias("classification"),
        source.alias("source"),
        F.col("p_retailprice").alias("rows"),
    )


def models(t: Tables) -> DataFrame:
    """Model registry with a binary-tree lineage."""
    parent = F.floor(F.col("s_suppkey") / 2)
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("model_tag"),
        F.when(F.col("s_suppkey") > 0, parent).alias("trained_from_id"),
        F.col("s_acctbal").alias("balance"),
    )


def dataset_uuid() -> Column:
    return minted_id("id")


def requests(t: Tables) -> DataFrame:
    """HTTP requests of five jobs."""
    status = (
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("event_id") % 10 == 0, 301)
        .when(F.col("event_id") % 10 == 1, 404)
        .otherwise(200)
    )
    return t.events.select(
        "event_id",
        "ts",
        F.concat(F.lit("job"), (F.col("user_id") % 5).cast("string")).alias("job"),
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        F.concat(
            F.lit("/"), "event_type", F.lit("/"), (F.col("user_id") % 7).cast("string")
        ).alias("path"),
        status.alias("status"),
        F.col("value").alias("duration_s"),
    )


def task_events(t: Tables) -> DataFrame:
    """Tasks with a status from the value and an end ``value`` minutes later."""
    value = F.col("value")
    status = (
        F.when(value < 2, "Q").when(value < 4, "R").when(value > 100, "F").otherwise("D")
    )
    ended = F.col("ts") + F.make_dt_interval(secs=F.round(value * 60).cast("decimal(18,6)"))
    return t.events.select(
        F.col("event_id").alias("id"),
        "event_type",
        "user_id",
        status.alias("task_status"),
        F.col("ts").alias("created_at"),
        F.when(~status.isin("Q", "R"), ended).alias("end_date"),
        F.when(status == "F", F.concat(F.lit("failed after "), "value")).alias("error_msg"),
    )


def task_tables(t: Tables) -> dict[str, DataFrame]:
    """Five task tables, one per event type."""
    tasks = task_events(t)
    of = lambda kind: tasks.filter(F.col("event_type") == kind)
    user = F.col("user_id").cast("string")
    return {
        "model_upload": of("click").withColumn("tag", F.concat(F.lit("hub/"), user)),
        "dataset_upload": of("view").withColumn("tag", F.concat(F.lit("set-"), user)),
        "synthesis": of("error"),
        "training": of("signup").withColumn("trained_model_id", F.col("user_id")),
        "evaluation": of("purchase").withColumn("model_tag", F.concat(F.lit("m-"), user)),
    }


def task_log(t: Tables) -> DataFrame:
    """Status events of one task per user."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "click", "Q")
        .when(kind == "view", "R")
        .when(kind == "error", "F")
        .otherwise("D")
    )
    return t.events.select(
        F.col("user_id").alias("id"),
        "ts",
        "event_id",
        status.alias("task_status"),
        F.when(kind == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias(
            "error_msg"
        ),
        F.when(F.col("value") > 20, F.col("value")).alias("progress"),
    )


def archive_members(t: Tables) -> DataFrame:
    """Pages as members of archives; paths come from the URL."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    kind = F.element_at(
        F.array(*map(F.lit, ["bin", "json", "txt", "Safetensors", "csv"])),
        (F.col("page_id") % 5 + 1).cast("int"),
    )
    page = F.col("page_id").cast("string")
    size = F.octet_length("html").cast("bigint")
    return t.pages.select(
        "page_id",
        F.floor(F.col("page_id") / 50).alias("archive"),
        F.concat(bare, F.lit("/f"), page, F.lit("."), kind).alias("member"),
        size.alias("file_size"),
        F.floor(size / (F.col("page_id") % 120 + 1)).alias("compress_size"),
    )

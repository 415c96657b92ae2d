"""Folder ingestion: new dataset files become canonical JSON lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embedlake.sources.files import ingest, list_files
from embedlake.sources.jsonl import canonical_lines

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def store(spark: SparkSession, files: DataFrame, out: str, batch_id: int, **options) -> None:
    """Ingest one batch of files: dataset lines, registry rows and rejects.

    Everything of a batch goes to folders named by the batch, so a repeated
    batch replaces its own output.
    """
    result = ingest(spark, files, **options)
    lines = canonical_lines(result.rows, keep=["dataset_id"])
    # One folder per dataset; rows of a large one stay spread over tasks.
    lines.write.mode("overwrite").partitionBy("dataset_id").text(f"{out}/datasets/batch={batch_id}")
    accepted = result.files.filter(F.col("error").isNull())
    accepted.select(
        F.col("dataset_id").alias("id"),
        F.lit(0).alias("version"),
        "file_name",
        F.regexp_replace("file_name", r"\.[^.]*$", "").alias("name"),
        "classification",
        "rows",
        F.lit("L").alias("source"),
        F.col("path").alias("source_file"),
    ).write.mode("overwrite").parquet(f"{out}/registry/batch={batch_id}")
    result.rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")


def with_empty_files(spark: SparkSession, files: DataFrame, folder: str, out: str, batch_id: int) -> DataFrame:
    """The files of a batch and the empty ones of the folder that no earlier batch has refused.

    The file stream never shows empty files, so they are listed whenever a batch
    runs; a repeated batch finds the same ones.
    """
    empty = list_files(spark, folder).where("length = 0").select("path", "length")
    if batch_id:
        told = spark.read.parquet(f"{out}/rejects").where(F.col("batch") < batch_id)
        empty = empty.join(told.select(F.col("source_file").alias("path")), "path", "left_anti")
    return files.select("path", "length").unionByName(empty)


def watch_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    max_files: int = 1_000,
    mapping: Mapping[str, str | None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Ingest files as they arrive, at most ``max_files`` per batch.

    Empty files get their verdict with the next batch of other files.
    """

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        store(session, with_empty_files(session, batch, folder, out, number), out, number, mapping=mapping)

    arriving = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )
    return (
        arriving.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(run)
        .start()
    )

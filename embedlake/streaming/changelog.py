"""Running streams into tables that a batch job can read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embedlake.session import work_dir
from embedlake.sources.remote import filesystem

MAX_FILES_PER_TRIGGER = 1_000


def read_stream(
    spark: SparkSession, path: str, max_files: int = MAX_FILES_PER_TRIGGER
) -> DataFrame:
    """Parquet files as a stream, a bounded number of files per micro-batch."""
    schema = spark.read.parquet(path).schema
    # A pattern may name a single file; a plain streaming path must be a folder.
    is_pattern = any(c in path for c in "*?[{")
    pattern = path if is_pattern else f"{path[:-1]}[{path[-1]}]"
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(pattern)
    )


# Batches after which the folders of a changelog are put together.
COMPACT_EVERY = 20


def start_changelog(
    updates: DataFrame, out: str, checkpoint: str, mode: str = "update", keys: Sequence[str] = (), **trigger
) -> StreamingQuery:
    """Write every batch of changed keys to its own folder.

    A repeated batch overwrites its folder, so results stay exactly-once. With
    `keys`, the log is compacted every COMPACT_EVERY batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if keys and batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            # This batch may come again, so it stays out of the base.
            compact(batch.sparkSession, out, keys, batch_id - 1)

    return (
        updates.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def _folders(out: str) -> tuple[list[int], list[int]]:
    """Ends of the complete bases, and the batches, both ascending."""
    system, path = filesystem(out)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    numbers = lambda name: sorted(int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith(f"{name}="))
    # Spark writes the marker last, so a base without it is not there yet.
    done = [n for n in numbers("upto") if system.get_file_info(f"{path}/upto={n}/_SUCCESS").type != fs.FileType.NotFound]
    return done, numbers("batch_id")


def compact(spark: SparkSession, out: str, keys: Sequence[str], upto: int) -> None:
    """Put all batches up to `upto` into one base, dealt out by key.

    A base counts from the moment it is complete, which replaces the folders it
    covers at once for every reader that starts then. Readers that started
    before still have theirs: only what the base before covers is removed.
    """
    bases, _ = _folders(out)
    if bases and bases[-1] >= upto:
        return
    newest = _newest(spark, out, keys, upto)
    if newest is None:
        return
    newest.repartition(*keys).write.mode("overwrite").parquet(f"{out}/upto={upto}")
    if bases:
        system, path = filesystem(out)
        _, batches = _folders(out)
        for name in [f"batch_id={n}" for n in batches if n <= bases[-1]] + [f"upto={n}" for n in bases[:-1]]:
            system.delete_dir(f"{path}/{name}")


def _newest(spark: SparkSession, out: str, keys: Sequence[str], upto: int | None = None) -> DataFrame | None:
    """Latest row of every key with its `batch_id`: the last base, and the batches after it."""
    bases, batches = _folders(out)
    bases = [n for n in bases if upto is None or n <= upto]
    begin = bases[-1] if bases else -1
    later = [n for n in batches if n > begin and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{out}/upto={begin}")] if bases else []
    if later:
        parts.append(spark.read.option("basePath", out).parquet(*[f"{out}/batch_id={n}" for n in later]))
    if not parts:
        return None
    log = reduce(DataFrame.unionByName, [p.withColumn("batch_id", F.col("batch_id").cast("long")) for p in parts])
    values = [c for c in log.columns if c not in keys]
    # A key changes at most once in a batch.
    newest = F.max_by(F.struct(*values), "batch_id").alias("row")
    return log.groupBy(*keys).agg(newest).select(*keys, "row.*")


def current_rows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Latest state of every key of a changelog."""
    newest = _newest(spark, out, keys)
    if newest is None:
        raise FileNotFoundError(f"{out} has no batch yet")
    return newest.drop("batch_id")


def replay(updates: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Process all available input and return the final state per key."""
    spark = updates.sparkSession
    out, checkpoint = work_dir(spark, name), work_dir(spark, f"{name}-checkpoint")
    start_changelog(updates, out, checkpoint).awaitTermination()
    return current_rows(spark, out, keys)


def replay_closed(
    rows: DataFrame, closing: DataFrame, build: Callable[[DataFrame], DataFrame], keys: Sequence[str], name: str, mode: str = "update"
) -> DataFrame:
    """Final rows per key of a stream that waits for its watermark.

    `rows` are written as files and streamed; then `closing`, whose time lies
    beyond all others, follows in a run that goes on from the checkpoint, so
    that everything that waits is told.
    """
    spark = rows.sparkSession
    folder, out, checkpoint = (work_dir(spark, f"{name}{end}") for end in ("-in", "", "-checkpoint"))
    for number, part in enumerate([rows, closing]):
        part.write.parquet(f"{folder}/{number}")
        stream = read_stream(spark, f"{folder}/*")
        start_changelog(build(stream), out, checkpoint, mode).awaitTermination()
    return current_rows(spark, out, keys)


def replay_appends(rows: DataFrame, name: str) -> DataFrame:
    """Process all available input of a stateless stream into a Parquet table."""
    spark = rows.sparkSession
    out, checkpoint = work_dir(spark, name), work_dir(spark, f"{name}-checkpoint")
    query = (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)

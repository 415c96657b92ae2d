"""Session settings, lineage cutting and shared work folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on. AQE splits hot join keys and
# re-checks sizes before it broadcasts; nothing in the package forces a
# broadcast of data that can grow.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stream state lives on disk next to the executor, not on its heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(
    app_name: str = "embedlake", cores: int | str = "*", **settings: str
) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", settings.pop("driver_memory", "8g"))
    )
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Give the session the settings that its owner has not set."""
    given = spark.conf.getAll
    for key, value in SQL_SETTINGS.items():
        if key not in given:
            spark.conf.set(key, value)
    if "spark.sql.shuffle.partitions" not in given and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a local one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="embedlake-"))
    # Spark appends a folder of its own and qualifies the path.
    return os.path.dirname(context.getCheckpointDir().rstrip("/"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's result in the reliable checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table or a stream."""
    return f"{checkpoint_root(spark).rstrip('/')}/embedlake/{name}-{uuid.uuid4().hex}"

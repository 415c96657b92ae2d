"""Requests for synthesis, the media files they may bring, and what became of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.functions.text import (
    MAX_UPLOAD_BYTES,
    MEDIA_EXTENSIONS,
    base_name,
    extension,
)

def request_error(n_files: Column, dataset_id: Column) -> Column:
    """A synthesis request needs files or an existing dataset."""
    return F.when(
        (F.coalesce(n_files, F.lit(0)) == 0) & dataset_id.isNull(), F.lit("nothing_given")
    )


def media_error(path: Column, length: Column, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """Why a media file is refused, null when it is accepted."""
    return F.when(
        ~extension(base_name(path)).isin(MEDIA_EXTENSIONS), F.lit("unsupported_format")
    ).when(length > max_bytes, F.lit("file_too_large"))


def ingest_outcome(
    files: DataFrame,
    by: str,
    error: str = "error",
    nothing_done: str = "No valid files could be processed",
) -> DataFrame:
    """Per task: uploaded, failed, final status and message."""
    ok = F.count_if(F.col(error).isNull())
    return (
        files.groupBy(by)
        .agg(ok.alias("uploaded"), F.count_if(F.col(error).isNotNull()).alias("failed"))
        .withColumn("task_status", F.when(F.col("uploaded") > 0, "D").otherwise("F"))
        .withColumn("error_msg", F.when(F.col("uploaded") == 0, F.lit(nothing_done)))
    )

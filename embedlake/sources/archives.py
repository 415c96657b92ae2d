"""ZIP archives: member listing and expansion."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.operators.archives import archive_limits
from embedlake.session import cut_lineage, work_dir
from embedlake.sources.remote import open_for_reading, open_for_writing

MEMBER_COLUMNS = ["archive", "number", "member", "file_size", "compress_size", "error"]
MEMBER_SCHEMA = (
    "archive string, number int, member string, file_size bigint, compress_size bigint, error string"
)


def _list(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path in frame["path"]:
            try:
                with open_for_reading(path) as raw, zipfile.ZipFile(raw) as archive:
                    rows = [
                        (path, i, m.filename, m.file_size, m.compress_size, None)
                        for i, m in enumerate(archive.infolist())
                        if not m.is_dir()
                    ]
            except (OSError, ValueError, zipfile.BadZipFile) as problem:
                rows = [(path, None, None, None, None, f"unreadable archive: {problem}")]
            if rows:
                yield pd.DataFrame(rows, columns=MEMBER_COLUMNS).astype(
                    {"number": "Int32", "file_size": "Int64", "compress_size": "Int64"}
                )


def list_members(archives: DataFrame) -> DataFrame:
    """Directory entries of every archive of a ``path`` table; no content."""
    return archives.select("path").mapInPandas(_list, MEMBER_SCHEMA)


def _extract(target: str):
    def one(archive: zipfile.ZipFile, member: zipfile.ZipInfo, out: str) -> str | None:
        try:
            blank = member.file_size > 0
            with archive.open(member) as source, open_for_writing(out) as sink:
                while chunk := source.read(1 << 20):
                    blank = blank and not chunk.strip()
                    sink.write(chunk)
            return "blank member" if blank else None
        except (OSError, ValueError, RuntimeError, zipfile.BadZipFile) as problem:
            return f"unreadable member: {problem}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, part in frame.groupby("archive"):
                rows = []
                with open_for_reading(path) as raw, zipfile.ZipFile(raw) as archive:
                    entries = archive.infolist()
                    for number, folder in zip(part["number"], part["folder"]):
                        member = entries[number]
                        # Only the base name is kept, so no member can leave
                        # its folder.
                        base = member.filename.rsplit("/", 1)[-1]
                        out = f"{target}/{folder}/{number}/{base}"
                        error = one(archive, member, out)
                        rows.append((path, member.filename, out, member.file_size, error))
                yield pd.DataFrame(rows, columns=["archive", "member", "path", "length", "error"])

    return run


def expand(
    spark: SparkSession, archives: DataFrame, target: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Write the members of every admissible archive below a shared folder.

    Returns (members with their new path and error, archives with their
    verdict). Members of one archive are spread over tasks, each of which reads
    only its own; a repeated task writes the same files again.
    """
    target = target or work_dir(spark, "members")
    listed = cut_lineage(list_members(archives))
    readable = listed.filter(F.col("error").isNull())
    broken = listed.filter(F.col("error").isNotNull()).select(
        "archive", F.lit("unreadable").alias("verdict")
    )
    verdicts = archive_limits(readable).select("archive", "verdict").unionByName(broken)
    admitted = (
        readable.filter(~F.col("member").rlike(r"^(__|\.)"))
        .join(verdicts.filter("verdict = 'ok'"), "archive", "left_semi")
        .select("archive", "number", F.md5("archive").alias("folder"))
        .repartition("archive", "number")
    )
    members = cut_lineage(
        admitted.mapInPandas(
            _extract(target),
            "archive string, member string, path string, length bigint, error string",
        )
    )
    return members, verdicts

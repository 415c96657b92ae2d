"""JSON-lines source and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlake.operators.canonical import ROLES
from embedlake.sources.remote import filesystem, open_for_writing

TRIPLET_SCHEMA = "question string, positive string, negative string"


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Stored canonical datasets; the fixed schema lets the scan prune columns."""
    return spark.read.schema(TRIPLET_SCHEMA).json(path)


def _leaves(fields: Sequence[T.StructField], path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
    for field in fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType.fields, here)
        else:
            yield here


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Every nested struct field as a top-level column with a joined name."""
    columns: list[Column] = []
    for path in _leaves(df.schema.fields, ()):
        quoted = ".".join(f"`{part}`" for part in path)
        columns.append(F.col(quoted).alias(separator.join(path)))
    return df.select(*columns)


def canonical_lines(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON object per row with the roles present, nulls written.

    Line and paragraph separators are escaped, so a line stays one line for
    every reader.
    """
    roles = [r for r in ROLES if r in df.columns]
    line = F.to_json(F.struct(*roles), {"ignoreNullFields": "false"})
    for separator, escaped in [("\u2028", "\\u2028"), ("\u2029", "\\u2029")]:
        line = F.replace(line, F.lit(separator), F.lit(escaped))
    return df.select(*keep, line.alias("value"))


def write_canonical(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write canonical JSON lines; returns the rows written.

    The commit protocol publishes the files at once, and the count comes from
    the write itself.
    """
    written = Observation()
    lines = canonical_lines(df).observe(written, F.count("*").alias("n"))
    lines.write.mode(mode).text(path)
    return written.get["n"]


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Any frame as JSON lines, UTF-8 unescaped and nulls written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


# What stands before, between and after the records of a file.
LAYOUTS = {"lines": ("", "\n", "\n"), "array": ("[", ",\n", "]"), "envelope": ('{"data": [', ",\n", "]}")}
EXTENSIONS = {"lines": "jsonl", "array": "json", "envelope": "json"}


def write_json_files(df: DataFrame, path: str, layout: str = "lines") -> DataFrame:
    """Any frame as JSON files of a layout, as `path, length` of the files written.

    A task streams its rows into one file and holds none of them. Files bear the
    name of the attempt, and the list, kept in `path/_files`, names those that
    counted.
    """
    before, between, after = LAYOUTS[layout]
    ending = EXTENSIONS[layout]

    def save(parts):
        name, out = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.{ending}", None
        for part in parts:
            for value in part.column("value"):
                start = out is None
                if start:
                    out = open_for_writing(name)
                out.write(((before if start else between) + value.as_py()).encode())
        if out is not None:
            out.write(after.encode())
            length = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "length": pa.array([length], "int64")})

    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.mapInArrow(save, "path string, length long").write.parquet(f"{path}/_files")
    return df.sparkSession.read.parquet(f"{path}/_files")


def delete_stored(path: str) -> bool:
    """Remove a stored dataset; False when there is none."""
    system, name = filesystem(path)
    kind = system.get_file_info(name).type
    if kind == FileType.NotFound:
        return False
    if kind == FileType.Directory:
        system.delete_dir(name)
    else:
        system.delete_file(name)
    return True

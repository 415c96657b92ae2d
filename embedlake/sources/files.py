"""Mixed dataset files to canonical rows, with a verdict for every file.

A job plans on the file list: one pass over byte ranges decides format,
delimiter, charset and the gates of each file, and where its records begin. One
reader per format then cuts any file into records, whatever its columns. Rows
carry their cells as a map, and the column choice of each file is one small
aggregate joined back.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.functions import text as tx
from embedlake.operators.canonical import ALIASES, ROLES, cell_violations, match_schema
from embedlake.operators.registry import minted_id
from embedlake.session import cut_lineage
from embedlake.sources import splits
from embedlake.sources.remote import filesystem
from embedlake.sources.workbook import read_workbooks


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Path and length of every file below files or folders; no content is read.

    Spark's own scan leaves out empty files, so one task lists those.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.load([_glob_safe(p) for p in paths]).select("path", "length")
    roots = spark.createDataFrame([(p,) for p in paths], "path string")
    return found.unionByName(roots.mapInPandas(_empty_files, "path string, length bigint"))


def _glob_safe(path: str) -> str:
    return "".join("\\" + c if c in "\\*?[]{}^" else c for c in path)


def _empty_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for root in frame["path"]:
            system, path = filesystem(root)
            found = system.get_file_info([path])
            if found[0].type == fs.FileType.Directory:
                found = system.get_file_info(fs.FileSelector(path, recursive=True))
            prefix = root.split(":", 1)[0] + ":" if ":/" in root else "file:"
            empty = [f.path for f in found if f.type == fs.FileType.File and f.size == 0]
            if empty:
                yield pd.DataFrame([(prefix + p, 0) for p in empty], columns=["path", "length"])


def inspect(files: DataFrame, max_bytes: int = tx.MAX_UPLOAD_BYTES, strict: bool = False) -> DataFrame:
    """Format, delimiter, encoding, shape and gate verdict of every file.

    ``strict`` also refuses files with a formula pattern or any ``@`` anywhere;
    the default escapes formulas cell by cell instead.
    """
    return _judged(_profiles(files), max_bytes, strict)


def _profiles(files: DataFrame, range_bytes: int = splits.RANGE_BYTES) -> DataFrame:
    return splits.profile(files.withColumn("extension", tx.extension(tx.base_name(F.col("path")))), range_bytes)


def _judged(profiles: DataFrame, max_bytes: int = tx.MAX_UPLOAD_BYTES, strict: bool = False) -> DataFrame:
    """One row per file from the rows of its ranges."""
    seen = profiles.groupBy("path", "length", "extension").agg(
        F.min("problem").alias("problem"),
        F.coalesce(F.every("utf8"), F.lit(True)).alias("utf8"),
        F.coalesce(F.some("nul"), F.lit(False)).alias("nul"),
        F.coalesce(F.some("marked"), F.lit(False)).alias("marked"),
        F.bit_xor("print").alias("print"),
        F.min("delimiter").alias("delimiter"),
        F.min("shape").alias("shape"),
        F.min("opens").alias("opens"),
    )
    text = F.col("extension").isin(*splits.TEXT_KINDS)
    error = (
        F.when(F.col("problem").isNotNull(), F.lit("unreadable"))
        .when(F.col("length") == 0, F.lit("empty_file"))
        .when(F.col("length") > max_bytes, F.lit("file_too_large"))
        .when(F.col("nul") & text, F.lit("nul_byte"))
        .when(~text & (F.col("extension") != "xlsx"), F.lit("unsupported_format"))
        .when(F.lit(strict) & F.col("marked") & text, F.lit("malicious_content"))
    )
    return seen.select(
        "path",
        "length",
        "extension",
        F.when(F.col("utf8"), splits.UTF8).otherwise(splits.LATIN1).alias("encoding"),
        "delimiter",
        "shape",
        "opens",
        "print",
        error.alias("error"),
    )


_OBJECT = "map<string,string>"


def _parsed(lines: DataFrame) -> DataFrame:
    """JSON objects of `path, value` as cells; anything else is malformed."""
    cells = F.from_json("value", _OBJECT)
    return lines.select("path", cells.alias("cells"), cells.isNull().alias("malformed"))


def _array_cells(ranges: DataFrame) -> DataFrame:
    """Arrays of objects and ``{"data": [...]}`` envelopes."""
    outer = F.col("shape") == "array"
    arrays = ranges.where(outer).withColumns({"level": F.lit(1), "closes": F.lit(None).cast("long")})
    held = splits.data_arrays(ranges.where(~outer))
    envelopes = ranges.where(~outer).drop("opens").join(held, "path").withColumn("level", F.lit(2))
    items = _parsed(splits.array_items(arrays.unionByName(envelopes)))
    lost = ranges.where(~outer & (F.col("begin") == 0)).join(held, "path", "left_anti")
    refused = lost.select("path", F.lit(None).cast(_OBJECT).alias("cells"), F.lit(True).alias("malformed"))
    return items.unionByName(refused)


def read_cells(spark: SparkSession, inspected: DataFrame, profiles: DataFrame, sheet: int = 0) -> DataFrame:
    """``path, cells, malformed`` rows of all files without an error.

    Each format is one reader, however many files there are and whatever their
    columns; `inspected` and `profiles` are those of the same files.
    """
    usable = inspected.filter(F.col("error").isNull()).select("path", "length", "extension", "encoding", "delimiter", "shape", "opens")
    # At most one row per format and shape.
    there = {(r["extension"], r["shape"]) for r in usable.select("extension", "shape").distinct().collect()}
    kinds = {ext for ext, _ in there}
    facts = usable.drop("length", "extension")
    parts = []
    if kinds & {"csv", "json"}:
        entered = cut_lineage(splits.entered(profiles).join(facts, "path"))
    if "csv" in kinds:
        parts.append(splits.csv_cells(entered.where("extension = 'csv'")))
    if "jsonl" in kinds:
        ranges = profiles.where("extension = 'jsonl'").select("path", "length", "begin", "stop")
        parts.append(_parsed(splits.text_lines(ranges.join(facts, "path"))))
    if there & {("json", "array"), ("json", "envelope")}:
        parts.append(_array_cells(entered.where("extension = 'json' AND shape <> 'object'")))
    if ("json", "object") in there:
        parts.append(splits.object_cells(usable.where("shape = 'object'")))
    if "xml" in kinds:
        parts.append(splits.xml_cells(usable.where("extension = 'xml'")))
    if "xlsx" in kinds:
        parts.append(read_workbooks(usable.filter("extension = 'xlsx'"), sheet))
    if not parts:
        return spark.createDataFrame([], splits.CELLS)
    return reduce(DataFrame.unionByName, parts)


# Up to so many files their facts go to every task; more are joined by sorting.
FEW_FILES = 10_000


def with_files(cells: DataFrame, files: DataFrame) -> DataFrame:
    """`cells` with the facts of their files, a materialised table of one row per `path`.

    Cells come from rows that name a range or a file each, so Spark takes them
    for small, and without a hint it broadcasts every cell through the driver.
    """
    few = files.limit(FEW_FILES + 1).count() <= FEW_FILES
    return cells.join(files.hint("broadcast" if few else "merge"), "path")


def _names(role: str, mapping: Mapping[str, str | None]) -> list[str]:
    explicit = mapping.get(role)
    return [explicit.lower()] if explicit is not None else [role, *ALIASES[role]]


def _key_for(name: Column) -> Column:
    """Header of a row that equals ``name`` in lower case; the last one wins."""
    matching = F.filter(F.map_keys("cells"), lambda k: F.lower(k) == name)
    return F.try_element_at(matching, F.lit(-1))


@dataclass
class Ingested:
    """Canonical ``rows`` of the good files and one verdict row per file."""

    rows: DataFrame
    files: DataFrame

    @property
    def rejects(self) -> DataFrame:
        return self.files.filter(F.col("error").isNotNull()).select(
            F.col("path").alias("source_file"), F.col("error").alias("reason"), "detail"
        )


class FileRejected(ValueError):
    """The only file of an upload was refused."""


def require_single(result: Ingested) -> Ingested:
    """Fail when the upload is one file and that file was refused.

    With several files the good ones count and the others are listed.
    """
    verdicts = result.files.select("path", "error", "detail").limit(2).collect()
    if len(verdicts) == 1 and verdicts[0]["error"]:
        raise FileRejected(": ".join(filter(None, verdicts[0])))
    return result


def ingest(
    spark: SparkSession,
    files: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    sheet: int = 0,
    strict: bool = False,
    range_bytes: int = splits.RANGE_BYTES,
) -> Ingested:
    """Read every file of a ``path, length`` table into canonical rows.

    ``mapping`` names columns explicitly; a role mapped to None is resolved by
    name. ``strict`` refuses files with formula patterns or malformed cells,
    which the default escapes or keeps. Files are read in ranges of
    ``range_bytes``, which change nothing but the number of tasks and the ids:
    a file's id follows its path and content.
    """
    mapping = dict(mapping or {})
    profiles = cut_lineage(_profiles(files, range_bytes))
    inspected = cut_lineage(_judged(profiles, strict=strict))
    cells = read_cells(spark, inspected, profiles, sheet)

    headers = F.transform(F.map_keys("cells"), lambda k: F.lower(k))
    ranks = {}
    for role in ROLES:
        hits = [
            F.when(F.array_contains(headers, n), F.lit(i))
            for i, n in enumerate(_names(role, mapping))
        ]
        ranks[role] = F.coalesce(*hits, F.lit(None).cast("int"))
    profile = cells.groupBy("path").agg(
        F.count("*").alias("num_rows"),
        F.count_if("malformed").alias("malformed_rows"),
        *[F.min(ranks[r]).alias(f"{r}_rank") for r in ROLES],
        # Rows without any header a role goes by.
        *[F.count_if(ranks[r].isNull()).alias(f"no_{r}") for r in ROLES],
    )

    def name_of(role: str) -> Column:
        names = F.array(*map(F.lit, _names(role, mapping)))
        return F.get(names, F.col(f"{role}_rank"))

    needed = ["question", "positive"] + (["negative"] if mapping.get("negative") else [])
    missing = F.coalesce(
        *[F.when(F.col(f"{r}_rank").isNull(), F.lit(mapping.get(r) or r)) for r in needed]
    )
    is_sheet = F.col("extension").isin("csv", "xlsx")
    judged = (
        inspected.join(profile, "path", "left")
        .withColumn("missing", missing)
        .withColumn(
            "error",
            F.coalesce(
                "error",
                F.when(F.coalesce("num_rows", F.lit(0)) == 0, F.lit("empty_file"))
                .when(F.col("malformed_rows") > 0, F.lit("invalid_format"))
                .when(F.col("missing").isNotNull(), F.lit("missing_column")),
            ),
        )
        .withColumn("detail", F.when(F.col("error") == "missing_column", F.col("missing")))
        .withColumns({f"{r}_name": name_of(r) for r in ROLES})
    )
    if strict:
        sheets = inspected.filter(is_sheet).select("path")
        table_cells = with_files(cells, sheets).select("path", F.explode("cells").alias("key", "cell"))
        worst = (
            cell_violations(table_cells, ["path"], ["cell"])
            .groupBy("path")
            .agg(F.min_by("violation", F.struct("violation", "shown")).alias("violation"))
        )
        judged = (
            judged.join(worst, "path", "left")
            .withColumn("detail", F.when(F.col("error").isNull(), F.col("violation")).otherwise(F.col("detail")))
            .withColumn("error", F.coalesce("error", F.when(F.col("violation").isNotNull(), F.lit("invalid_format"))))
        )
    judged = judged.withColumn(
        "classification",
        F.when(F.col("error").isNull(), F.when(F.col("negative_name").isNotNull(), "T").otherwise("D")),
    )
    judged = cut_lineage(judged.withColumn("dataset_id", minted_id("path", "length", "print")))

    good = judged.filter(F.col("error").isNull()).select(
        "path", "dataset_id", "extension", "classification", *[f"{r}_name" for r in ROLES]
    )
    values = {r: F.try_element_at("cells", _key_for(F.col(f"{r}_name"))) for r in ROLES}
    escaped = {
        r: F.when(is_sheet, tx.escape_formula(v)).otherwise(v).alias(r) for r, v in values.items()
    }
    rows = with_files(cells, good).select("path", "dataset_id", "classification", *escaped.values())
    names = tx.sanitized_name(F.col("path"))
    report = judged.select(
        "path",
        "length",
        "extension",
        "encoding",
        "delimiter",
        "error",
        "detail",
        F.col("num_rows").alias("rows"),
        *[f"no_{r}" for r in ROLES],
        "classification",
        "dataset_id",
        names["file_name"].alias("file_name"),
    )
    return Ingested(rows, report)


def scan_subsets(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """All subsets and splits of a dataset laid out as ``subset=/split=`` folders.

    Every subset and split goes by the first allowed schema that its own keys
    cover; rows keep the registry and file name of their part. A row that lacks
    one of its schema's keys is skipped, one whose value is null is kept. A part
    that no schema fits, and a line that is no object, fails the job.
    """
    lines = spark.read.text(root)
    split = F.col("split") if "split" in lines.columns else F.lit(None).cast("string")
    subset = F.col("subset") if "subset" in lines.columns else F.lit("default")
    broken = F.raise_error(F.lit("a line is no JSON object")).cast(_OBJECT)
    blank = F.col("value").rlike(r"^\s*$")
    rows = lines.where(~blank).select(
        F.struct(subset.cast("string").alias("subset"), split.cast("string").alias("split")).alias("part"),
        # Filters may move below this, so it does not rely on the one above.
        F.coalesce(F.from_json("value", _OBJECT), F.when(~blank, broken)).alias("cells"),
    )
    keys = rows.select("part", F.explode("cells").alias("key", "cell")).groupBy("part")
    lost = F.raise_error(F.concat(F.lit("no allowed schema fits "), F.to_json("columns"))).cast("string")
    matched = match_schema(keys.agg(F.collect_set("key").alias("columns")), "columns")
    matched = matched.withColumn("question_column", F.coalesce("question_column", lost))
    needed = F.array_compact(F.array(*[f"{r}_column" for r in ROLES]))
    joined = rows.join(matched, "part").where(F.size(F.array_except(needed, F.map_keys("cells"))) == 0)
    names = tx.dataset_names(F.lit(tag), F.col("part.split"), F.col("part.subset"))
    values = {r: F.try_element_at("cells", F.col(f"{r}_column")).alias(r) for r in ROLES}
    return joined.select(*[c.alias(n) for n, c in names.items()], *values.values(), "classification")

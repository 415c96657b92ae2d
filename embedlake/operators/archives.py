"""Archive member checks and layout, over one row per member.

Path containment is tested by equality with a path's own ancestors, never by
comparing all pairs of paths of an archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.functions.text import MAX_UPLOAD_BYTES, base_name, extension
from embedlake.session import cut_lineage

MAX_MEMBERS = 10_000
MAX_RATIO = 100.0
# Model weight suffixes and the members a model may contain.
MODEL_EXTENSIONS = ["pt", "pth", "bin", "model", "safetensors"]
ALLOWED_EXTENSIONS = [*MODEL_EXTENSIONS, "json"]


def archive_limits(
    members: DataFrame,
    max_members: int = MAX_MEMBERS,
    max_bytes: int = MAX_UPLOAD_BYTES,
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """Member count, size, worst compression ratio and verdict per archive.

    ``members`` has ``archive, member, file_size, compress_size``. The ratio is
    uncompressed over compressed, so archive bombs are caught.
    """
    visible = ~F.col("member").rlike(r"^(__|\.)")
    ratio = F.when(
        visible & (F.col("file_size") > 0),
        F.col("file_size") / F.greatest(F.col("compress_size"), F.lit(1)),
    )
    return (
        members.filter(~F.endswith("member", F.lit("/")))
        .groupBy("archive")
        .agg(
            F.count("*").alias("n_members"),
            F.sum("file_size").alias("total_bytes"),
            F.max(ratio).alias("max_ratio"),
            F.count_if(visible).alias("n_usable"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("n_members") > max_members, F.lit("too_many_files"))
            .when(F.col("total_bytes") > max_bytes, F.lit("too_large"))
            .when(F.col("max_ratio") > max_ratio, F.lit("suspicious_ratio"))
            .when(F.col("n_usable") == 0, F.lit("no_valid_files"))
            .otherwise(F.lit("ok")),
        )
    )


def directory(path: Column) -> Column:
    """Path without its last segment, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All proper leading directories of a path, shortest first."""
    parts = F.split(path, "/")
    depths = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: n < F.size(parts),
    )
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def model_directories(members: DataFrame) -> DataFrame:
    """Outermost directories of each archive that hold a model file."""
    is_model = extension(base_name(F.col("member"))).isin(MODEL_EXTENSIONS)
    found = (
        members.filter(is_model & F.contains("member", F.lit("/")))
        .select("archive", directory(F.col("member")).alias("model_dir"))
        .distinct()
    )
    nested = (
        found.select(
            "archive", "model_dir", F.explode(ancestors(F.col("model_dir"))).alias("outer_dir")
        )
        .join(
            found.withColumnRenamed("model_dir", "outer_dir"),
            ["archive", "outer_dir"],
            "left_semi",
        )
        .select("archive", "model_dir")
        .distinct()
    )
    return found.join(nested, ["archive", "model_dir"], "left_anti")


def toplevel_directories(members: DataFrame) -> DataFrame:
    """Members with the model directory they belong to.

    An archive without model files groups by the first path segment; members
    outside every group are left out.
    """
    # Few rows, read three times below.
    dirs = cut_lineage(model_directories(members))
    leading = F.explode(ancestors(F.col("member"))).alias("model_dir")
    inside = members.select("archive", "member", leading).join(
        dirs, ["archive", "model_dir"], "left_semi"
    )
    plain = (
        members.filter(F.contains("member", F.lit("/")))
        .join(dirs.select("archive").distinct(), "archive", "left_anti")
        .select(
            "archive", "member", F.substring_index("member", "/", 1).alias("model_dir")
        )
    )
    return inside.unionByName(plain)


def extraction_plan(grouped: DataFrame) -> DataFrame:
    """Common parent per group and the relative target of allowed members."""
    parent = directory(F.col("member"))
    # The shortest parent; among equally short ones the first by name.
    shortest = F.min(
        F.when(
            F.contains("member", F.lit("/")) & ~F.endswith("member", F.lit("/")),
            F.struct(F.length(parent), parent.alias("dir")),
        )
    )
    prefixes = grouped.groupBy("archive", "model_dir").agg(
        shortest["dir"].alias("common_prefix"), F.count("*").alias("n_members")
    )
    joined = grouped.join(prefixes, ["archive", "model_dir"])
    below = F.startswith("member", F.concat("common_prefix", F.lit("/")))
    relative = F.when(
        below, F.expr("substring(member, length(common_prefix) + 2)")
    ).otherwise(base_name(F.col("member")))
    allowed = extension(base_name(F.col("member"))).isin(ALLOWED_EXTENSIONS)
    return joined.select(
        "archive",
        "model_dir",
        "member",
        "common_prefix",
        F.when(allowed, relative).alias("target"),
    )

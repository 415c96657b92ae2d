"""Running totals, row positions and exact-n samples without big windows.

A window over a whole group puts the group in one task. Here the order key is
cut into nested cells (coarse to fine) whose expressions grow with the key.
Cell totals are small and aggregate map-side; windows only run over the cells
of one parent and over the rows of one finest cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radix_levels(key: Column) -> list[Column]:
    """Cells for a unique 64-bit integer key.

    At most 2^20 rows share a finest cell, 2^20 of these a parent, and there
    are 2^24 parents at the very most.
    """
    wide = key.cast("bigint")
    return [F.shiftright(wide, 40), F.shiftright(wide, 20)]


def time_levels(ts: Column) -> list[Column]:
    """Cells for distinct instants: about 19 hours, then about one second.

    A finest cell holds 2^20 microseconds, a parent 2^16 of these.
    """
    micros = F.unix_micros(ts.cast("timestamp"))
    return [F.shiftright(micros, 36), F.shiftright(micros, 20)]


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[Column],
    levels: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "before",
) -> DataFrame:
    """Add the total of ``value`` over all earlier rows of the same group.

    ``levels`` must not decrease along ``order``. Null groups are a group, and
    null order keys come first in a cell of their own. Keep ``df`` narrow: its
    rows move once.
    """
    cells = [f"__cell{i}" for i in range(len(levels))]
    groups = {f"__by{i}": F.struct(F.col(c).alias("v")) for i, c in enumerate(by)}
    by = list(groups)
    # A struct equals another one with the same null, so no row is lost below.
    wrapped = {c: F.struct(level.alias("v")) for c, level in zip(cells, levels)}
    rows = df.withColumns({**groups, **wrapped, "__value": value})
    totals = rows.groupBy(*by, *cells).agg(F.sum("__value").alias("__total"))

    offsets = None
    for depth, cell in enumerate(cells):
        parents = by + cells[:depth]
        level = (
            totals
            if depth == len(cells) - 1
            else totals.groupBy(*parents, cell).agg(F.sum("__total").alias("__total"))
        )
        window = (
            Window.partitionBy(*parents)
            .orderBy(cell)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        earlier = F.coalesce(F.sum("__total").over(window), F.lit(0))
        level = level.select(*parents, cell, earlier.alias("__earlier"))
        if offsets is None:
            offsets = level.withColumnRenamed("__earlier", "__offset")
        else:
            offsets = level.join(offsets, parents).select(
                *parents, cell, (F.col("__earlier") + F.col("__offset")).alias("__offset")
            )

    inside = (
        Window.partitionBy(*by, *cells)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(offsets, by + cells)
        .withColumn(
            name,
            F.coalesce(F.sum("__value").over(inside), F.lit(0)) + F.col("__offset"),
        )
        .drop(*by, *cells, "__value", "__offset")
    )


def row_position(
    df: DataFrame,
    order: Sequence[Column],
    levels: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Zero-based position of every row in its group."""
    return running_total(df, F.lit(1).cast("bigint"), order, levels, by, name)


# Rows of a sample that a top-n per task and one merge may hold.
TOP_ROWS = 50_000
# Digest characters that name a cell: 16^3 counts come back per level.
CELL_CHARS = 3
DIGEST_CHARS = 30


def exact_sample(
    df: DataFrame, n: int, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """Seeded sample of exactly ``n`` rows (all rows when there are fewer).

    ``key`` identifies a row; rows with equal keys are ordered as they come.
    The choice depends on keys and seed only, not on partitioning: the rows of
    the smallest digests, which up to TOP_ROWS are a top-n per task, merged, in
    one scan. Beyond, counting digest prefixes finds, level by level, the cell
    that holds the n-th smallest digest; all rows before it are a filter, and of
    the rows with that very digest the first are taken by a top-n, so exactly n
    come back; then ``df`` is read once per level, so materialise an expensive
    one first.
    """
    if n <= 0:
        return df.limit(0)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    digest = F.substring(digest, 1, DIGEST_CHARS)
    if n <= TOP_ROWS:
        return df.orderBy(digest, *key).limit(n)
    hashed = df.select(digest.alias("__digest"))
    rest, prefix = n, ""
    while len(prefix) < DIGEST_CHARS:
        cell = F.substring("__digest", 1, len(prefix) + CELL_CHARS)
        inside = hashed.filter(F.startswith("__digest", F.lit(prefix)))
        counts = dict(inside.groupBy(cell.alias("cell")).count().collect())
        for name in sorted(counts):
            if rest <= counts[name]:
                break
            rest -= counts[name]
        else:
            return df
        prefix = name
        if counts[name] == rest:
            return df.filter(F.substring(digest, 1, len(prefix)) <= prefix)
    before = df.filter(digest < prefix)
    return before.unionByName(df.filter(digest == prefix).orderBy(*key).limit(rest))

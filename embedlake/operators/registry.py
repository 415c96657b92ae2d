"""Registry tables: lookups, guards, versions, lineage, paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedlake.functions.text import is_uuid, safe_model_name
from embedlake.session import cut_lineage


def minted_id(*parts: str) -> Column:
    """UUID-shaped id from a content hash: the same row gets the same id."""
    digest = F.md5(F.concat_ws("\x1f", *[F.col(p).cast("string") for p in parts]))
    return F.regexp_replace(
        digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def append(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Append rows to a registry table and return the table."""
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def lookup(requests: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Registry row of each requested key with a ``found`` flag."""
    return requests.join(registry.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def missing_references(refs: DataFrame, registry: DataFrame, ref: str, key: str) -> DataFrame:
    """All unusable references with their reason and how often they occur.

    References are counted first, so a popular one reaches the join once.
    """
    counted = refs.groupBy(F.col(ref).alias("ref")).agg(F.count("*").alias("n_refs"))
    known = registry.select(F.col(key).alias("ref"))
    reason = F.when(~F.coalesce(is_uuid(F.col("ref")), F.lit(False)), F.lit("invalid_id"))
    return counted.join(known, "ref", "left_anti").select(
        "ref", "n_refs", F.coalesce(reason, F.lit("not_found")).alias("reason")
    )


def changed_since(registry: DataFrame, held: DataFrame, key: str, version: str) -> DataFrame:
    """Registry rows whose version a client does not hold yet."""
    return registry.join(held.select(key, version), [key, version], "left_anti")


def names_with_prefix(requests: DataFrame, tag: str, names: DataFrame, name: str) -> DataFrame:
    """Requested tags that begin at least one registered name.

    A prefix test becomes an equi-join: every name is cut at the tag lengths
    that occur (at most the 128 of the name column), and duplicates collapse
    before the shuffle.
    """
    tags = requests.select(F.col(tag).alias("__tag")).distinct()
    lengths = tags.select(F.length("__tag").alias("__len")).distinct()
    all_lengths = lengths.agg(F.collect_set("__len").alias("__lens")).scalar()
    cuts = (
        names.select(F.col(name).alias("__name"), all_lengths.alias("__lens"))
        .select("__name", F.explode("__lens").alias("__len"))
        .filter(F.length("__name") >= F.col("__len"))
        .select(F.expr("substring(__name, 1, __len)").alias("__tag"))
        .distinct()
    )
    return tags.join(cuts, "__tag", "left_semi").withColumnRenamed("__tag", tag)


def duplicate_guard(
    requests: DataFrame, registry: DataFrame, running: DataFrame, tag: str = "tag"
) -> DataFrame:
    """Verdict of upload requests: already stored, being uploaded, or admitted.

    ``registry`` has the hub datasets' ``name``; ``running`` the tags in work.
    """
    stored = names_with_prefix(requests, tag, registry, "name").withColumn("stored", F.lit(True))
    active = running.select(tag).distinct().withColumn("active", F.lit(True))
    return (
        requests.join(stored, tag, "left")
        .join(active, tag, "left")
        .withColumn(
            "verdict",
            F.when(F.col("stored"), F.lit("already_exists"))
            .when(F.col("active"), F.lit("being_uploaded"))
            .otherwise(F.lit("admitted")),
        )
        .drop("stored", "active")
    )


def new_and_existing(
    found: DataFrame, registry: DataFrame, tag: str, registered: str
) -> DataFrame:
    """Candidates with their safe tag and whether the registry has it already."""
    tagged = found.withColumn("safe_tag", safe_model_name(F.col(tag)))
    known = registry.select(F.col(registered).alias("safe_tag")).distinct()
    return tagged.join(known.withColumn("exists", F.lit(True)), "safe_tag", "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def resolve_evaluation_dataset(
    requests: DataFrame, datasets: DataFrame, tasks: DataFrame, folder: str = "data/datasets"
) -> DataFrame:
    """Path, info text or error of evaluation requests.

    Exactly one of ``dataset_id`` and ``training_task_id`` must be given.
    """
    by_id = datasets.select("dataset_id", "file_name")
    by_task = tasks.select("training_task_id", "validation_dataset_path").withColumn(
        "task_known", F.lit(True)
    )
    joined = requests.join(by_id, "dataset_id", "left").join(by_task, "training_task_id", "left")
    has_dataset, has_task = F.col("dataset_id").isNotNull(), F.col("training_task_id").isNotNull()
    error = (
        F.when(has_dataset & has_task, F.lit("both given"))
        .when(~has_dataset & ~has_task, F.lit("none given"))
        .when(has_dataset & F.col("file_name").isNull(), F.lit("dataset not found"))
        .when(has_task & F.col("task_known").isNull(), F.lit("training task not found"))
        .when(
            has_task & F.col("validation_dataset_path").isNull(),
            F.lit("no validation dataset"),
        )
    )
    path = F.when(
        error.isNull(),
        F.coalesce(
            F.concat(F.lit(folder + "/"), F.col("file_name")),
            F.col("validation_dataset_path"),
        ),
    )
    info = F.when(
        has_dataset,
        F.coalesce(
            F.concat(F.lit("Dataset: "), F.col("file_name")),
            F.concat(F.lit("Dataset ID: "), F.col("dataset_id").cast("string")),
        ),
    ).when(
        has_task,
        F.concat(F.lit("Training validation set: "), F.col("training_task_id").cast("string")),
    )
    return joined.select(
        *requests.columns,
        path.alias("dataset_path"),
        info.alias("dataset_info"),
        error.alias("error"),
    )


def cascade_delete(
    parents: DataFrame, children: DataFrame, deleted: DataFrame, key: str, child_key: str
) -> tuple[DataFrame, DataFrame]:
    """Remaining parents and the children whose parent was not deleted."""
    ids = deleted.select(key).distinct()
    return (
        parents.join(ids, key, "left_anti"),
        children.join(ids.withColumnRenamed(key, child_key), child_key, "left_anti"),
    )


OUTCOME_APPLIED, OUTCOME_MISSING, OUTCOME_STALE = "updated", "not_found", "version_mismatch"


def optimistic_update(
    current: DataFrame,
    updates: DataFrame,
    fields: Sequence[str],
    key: str = "id",
    version: str = "version",
    expected: str = "expected_version",
    sequence: str = "seq",
    chained: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Apply versioned updates; returns (outcome per update, new snapshot).

    Updates of one row count in ``sequence`` order: an update applies when its
    expected version is the row's version at that moment. The update that can
    follow another one is the first later one that expects the next version, so
    the applied ones are a chain that starts at the stored version; pointer
    doubling walks it in log2(updates of one row) rounds. ``chained=False``
    says that no key occurs twice: then nothing follows. A null field keeps the
    stored value; an update without a sequence or expected version never
    applies. ``sequence`` is unique within a key.
    """
    fields = list(fields)
    usable = updates.select(
        key, F.col(expected).alias("__exp"), F.col(sequence).alias("__seq")
    ).dropna()
    stored = current.select(key, F.col(version).alias("__ver"))
    first = (
        usable.join(stored, key)
        .filter("__exp = __ver")
        .groupBy(key)
        .agg(F.min("__seq").alias("__seq"))
    )
    if chained:
        # Every update asks, at the version it leads to, for the next update
        # that expects this version; both meet in one sorted run.
        asks = usable.select(key, (F.col("__exp") + 1).alias("__exp"), "__seq", F.lit(True).alias("__ask"))
        offers = usable.withColumn("__ask", F.lit(False))
        later = (
            Window.partitionBy(key, "__exp")
            .orderBy(F.desc("__seq"), F.desc("__ask"))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        offered = F.min(F.when(~F.col("__ask"), F.col("__seq"))).over(later)
        links = asks.unionByName(offers).withColumn("__next", offered).filter("__ask")
        links = links.select(key, "__seq", "__next")
        most = usable.groupBy(key).count().agg(F.max("count")).first()[0] or 0
        heads = first.withColumn("__on", F.lit(True))
        state = cut_lineage(links.join(heads, [key, "__seq"], "left").fillna(False, ["__on"]))
        for _ in range(most.bit_length()):
            # One round: whoever is on the chain puts its target on it, and
            # every pointer moves on to its target's target.
            target = state.select(key, F.col("__seq").alias("__next"), F.col("__next").alias("__far"))
            moved = state.join(target, [key, "__next"], "left")
            reached = state.filter("__on and __next is not null").select(
                key, F.col("__next").alias("__seq"), F.lit(True).alias("__hit")
            )
            state = cut_lineage(
                moved.join(reached.distinct(), [key, "__seq"], "left").select(
                    key,
                    "__seq",
                    F.col("__far").alias("__next"),
                    (F.col("__on") | F.coalesce("__hit", F.lit(False))).alias("__on"),
                )
            )
        first = state.filter("__on")
    winners = first.select(key, F.col("__seq").alias(sequence))
    applied = updates.join(winners, [key, sequence]).groupBy(key).agg(
        F.count("*").cast("int").alias("__steps"),
        *[
            F.max_by(f, F.when(F.col(f).isNotNull(), F.col(sequence))).alias(f"__{f}")
            for f in fields
        ],
    )
    snapshot = current.join(applied, key, "left").select(
        *[c for c in current.columns if c not in (version, *fields)],
        (F.col(version) + F.coalesce("__steps", F.lit(0))).alias(version),
        *[F.coalesce(f"__{f}", f).alias(f) for f in fields],
    )
    known = current.select(key, F.lit(True).alias("__known"))
    outcomes = (
        updates.join(known, key, "left")
        .join(winners.withColumn("__applied", F.lit(True)), [key, sequence], "left")
        .withColumn(
            "outcome",
            F.when(F.col("__known").isNull(), F.lit(OUTCOME_MISSING))
            .when(F.col("__applied"), F.lit(OUTCOME_APPLIED))
            .otherwise(F.lit(OUTCOME_STALE)),
        )
        .drop("__known", "__applied")
    )
    return outcomes, snapshot.select(*current.columns)


def latest_versions(log: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Current row of every key in an append-only snapshot log."""
    rest = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.col(version)).alias("__row")
    return log.groupBy(key).agg(newest).select(key, "__row.*").select(*log.columns)


def lineage(models: DataFrame, key: str = "id", parent: str = "trained_from_id") -> DataFrame:
    """Root and depth of every model by pointer doubling.

    Each round replaces the pointer of every open row by its target's pointer,
    so a chain of length n needs log2(n) rounds. A row is done, and neither
    joined nor written again, once it points at a root; a parent that is not
    registered counts as one. A row still open after log2(rows) + 1 rounds
    hangs on a cycle and comes back with a null root and depth.
    """
    is_root = F.col(parent).isNull()
    start = models.select(
        F.col(key),
        F.coalesce(parent, key).alias("__ptr"),
        F.when(is_root, 0).otherwise(1).cast("bigint").alias("depth"),
        is_root.alias("__done"),
    )
    written = cut_lineage(start)
    done = [written.filter("__done")]
    pending = written.filter("not __done")
    for _ in range(written.count().bit_length() + 1):
        if pending.isEmpty():
            break
        target = reduce(DataFrame.unionByName, [*done, pending]).select(
            F.col(key).alias("__ptr"),
            F.col("__ptr").alias("__next"),
            F.col("depth").alias("__hops"),
            F.col("__done").alias("__end"),
        )
        moved = pending.join(target, "__ptr", "left").select(
            key,
            F.coalesce("__next", "__ptr").alias("__ptr"),
            (F.col("depth") + F.coalesce("__hops", F.lit(0))).alias("depth"),
            F.coalesce("__end", F.lit(True)).alias("__done"),
        )
        moved = cut_lineage(moved)
        done.append(moved.filter("__done"))
        pending = moved.filter("not __done")
    cyclic = pending.withColumns(
        {"__ptr": F.lit(None).cast(pending.schema["__ptr"].dataType), "depth": F.lit(None).cast("bigint")}
    )
    return reduce(DataFrame.unionByName, [*done, cyclic]).select(
        key, F.col("__ptr").alias("root_id"), "depth"
    )


# Rows of a page, with those before it, that a top-n may hold.
NEAR_ROWS = 10_000


def page_by_offset(
    registry: DataFrame, limit: int, offset: int = 0, key: str = "id"
) -> DataFrame:
    """Rows of one page in ``key`` order with the total row count.

    Any orderable key will do; nulls come first, and rows of equal keys keep
    places of their own, by a hash of the row. A near page is a top-n. For a far one only the keys are
    dealt out by ranges; their counts say which range the page begins in, and
    the rows between its bounds are read.
    """
    order = [F.col(key), F.xxhash64(*[F.col(f"`{c}`") for c in registry.columns])]
    if offset + limit <= NEAR_ROWS:
        total = F.lit(registry.count()).cast("long").alias("total")
        return registry.orderBy(*order).offset(offset).limit(limit).select("*", total)
    keys = registry.select(F.col(key).alias("k")).repartitionByRange("k")
    # One row per partition comes back, and one evaluation gives all of them.
    sizes = keys.groupBy(F.spark_partition_id().alias("r")).agg(
        F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("k").isNull()).alias("nulls")
    )
    before, bounds, empty_keys, total = 0, [], False, 0
    for row in sizes.orderBy("r").collect():
        if before < offset + limit and before + row["n"] > offset:
            bounds.append((row["low"], row["high"]))
            empty_keys = empty_keys or row["nulls"] > 0
            skipped = before if len(bounds) == 1 else skipped
        before += row["n"]
        total = before
    if not bounds:
        return registry.limit(0).withColumn("total", F.lit(total).cast("long"))
    lows = [low for low, _ in bounds if low is not None]
    highs = [high for _, high in bounds if high is not None]
    inside = F.col(key).isNull() if empty_keys else F.lit(False)
    if lows:
        inside = inside | F.col(key).between(F.lit(min(lows)), F.lit(max(highs)))
    page = registry.where(inside).orderBy(*order).offset(offset - skipped).limit(limit)
    return page.withColumn("total", F.lit(total).cast("long"))


# Rows of one range of a stored listing.
RANGE_ROWS = 100_000


def write_listing(registry: DataFrame, path: str, key: str = "id", range_rows: int = RANGE_ROWS) -> None:
    """Store a table in ``key`` order with an index of its ranges, for paging.

    ``path/rows`` has a folder per range, ``path/index`` its first row's place
    and its size. Equal keys are ordered by a hash of their row, so a key of any
    size is spread over ranges; only rows that are equal stay together.
    """
    ranges = max(1, -(-registry.count() // range_rows))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in registry.columns])
    held = registry.withColumn("__tie", tie).repartitionByRange(ranges, key, "__tie")
    held = held.withColumn("__range", F.spark_partition_id()).sortWithinPartitions(key, "__tie")
    if registry.isEmpty():
        # A folder without files has no columns.
        held.drop("__range").write.parquet(f"{path}/rows/__range=0")
    else:
        held.write.partitionBy("__range").parquet(f"{path}/rows")
    stored = registry.sparkSession.read.parquet(f"{path}/rows")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("__range").agg(F.count("*").alias("n"))
    sizes.select("__range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """One page of a stored listing with the total row count: reads the ranges it lies in, shuffles nothing."""
    index = spark.read.parquet(f"{path}/index")
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    touched = index.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("__range").collect()
    rows = spark.read.parquet(f"{path}/rows")
    inside = rows.where(F.col("__range").isin([r["__range"] for r in touched]))
    skipped = offset - touched[0]["before"] if touched else 0
    page = inside.orderBy(key, "__tie").offset(skipped).limit(limit)
    return page.drop("__tie", "__range").withColumn("total", F.lit(total).cast("long"))


def page_by_number(registry: DataFrame, page: int, size: int, key: str = "id") -> DataFrame:
    """One page by number with the page count."""
    if page < 1 or not 5 <= size <= 100:
        raise ValueError("page starts at 1, size is 5 to 100")
    return page_by_offset(registry, size, (page - 1) * size, key).withColumn(
        "total_pages", F.ceil(F.col("total") / size)
    )


def newest(df: DataFrame, n: int = 20, created: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(created), key).limit(n)

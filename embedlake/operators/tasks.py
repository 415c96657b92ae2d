"""Unified task feed and folded task states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEED_COLUMNS = ["id", "tag", "task_status", "created_at", "end_date", "error_msg", "task_type"]
TASK_TYPES = ["model_upload", "synthesis", "dataset_upload", "training", "evaluation"]
UNFINISHED = ["Q", "R"]
FINISHED = ["D", "F"]


def recent(now: Column, hours: int) -> Column:
    """Unfinished, or finished within the window; no end date counts as now."""
    threshold = now - F.make_dt_interval(hours=F.lit(hours))
    return F.col("task_status").isin(UNFINISHED) | (
        F.coalesce(F.col("end_date"), now) >= threshold
    )


def task_branch(
    table: DataFrame, task_type: str, models: DataFrame | None = None
) -> DataFrame:
    """Feed columns of one task table.

    Training tasks take the tag of their trained model, evaluation tasks their
    model tag; synthesis tasks have none.
    """
    if "trained_model_id" in table.columns and models is not None:
        tags = models.select(F.col("id").alias("trained_model_id"), "model_tag")
        table = table.join(tags, "trained_model_id", "left")
        tag = F.col("model_tag")
    elif "model_tag" in table.columns:
        tag = F.col("model_tag")
    elif "tag" in table.columns:
        tag = F.col("tag")
    else:
        tag = F.lit(None)
    return table.select(
        "id",
        tag.cast("string").alias("tag"),
        "task_status",
        "created_at",
        "end_date",
        "error_msg",
        F.lit(task_type).alias("task_type"),
    )


def task_feed(
    tables: Mapping[str, DataFrame],
    now: Column,
    within_hours: int,
    models: DataFrame | None = None,
    task_types: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
    tag: str | None = None,
) -> DataFrame:
    """Bag union of the requested task tables with the feed filters.

    Filters sit above the union; Catalyst moves them into each branch's scan.
    """
    branches = [task_branch(tables[t], t, models) for t in task_types or TASK_TYPES]
    feed = reduce(DataFrame.unionByName, branches).filter(recent(now, within_hours))
    if statuses:
        feed = feed.filter(F.col("task_status").isin(list(statuses)))
    if tag:
        feed = feed.filter(F.col("tag") == tag)
    return feed


def newest_first(
    feed: DataFrame,
    limit: int | None = None,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    """Newest tasks first; task type and id break ties.

    ``after`` is the ``(created_at, task_type, id)`` of the last row seen: the
    cheap way to reach far pages, where an offset sorts all it skips.
    """
    if limit is not None and not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    if after is not None:
        created, task_type, task_id = map(F.lit, after)
        feed = feed.filter(
            (F.col("created_at") < created)
            | (
                (F.col("created_at") == created)
                & (F.struct("task_type", "id") > F.struct(task_type, task_id))
            )
        )
    ordered = feed.orderBy(F.desc("created_at"), "task_type", "id")
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def _last(value: str | Column, order: Column) -> Column:
    """Latest value, null included."""
    return F.max_by(value, order)


def _last_set(value: str, order: Column) -> Column:
    """Latest value that is not null."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), order))


UPLOAD_RULE, RUN_RULE, EVALUATION_RULE = "upload", "run", "evaluation"


def task_states(
    log: DataFrame,
    rule: str,
    key: Sequence[str] = ("id",),
    order: Sequence[str] = ("ts",),
    kept_fields: Sequence[str] = (),
) -> DataFrame:
    """Fold status events (``task_status, error_msg, ts``) into one row per task.

    upload: every event sets the end date and overwrites the error.
    run (training, synthesis): D and F set the end date, errors only when given.
    evaluation: errors only when given, the end date is never set.
    ``kept_fields`` follow "only given values overwrite". All folds are plain
    aggregates, so a task with very many events is reduced before the shuffle.
    """
    by_order = F.struct(*order)
    done = F.when(F.col("task_status").isin(FINISHED), by_order)
    no_date = F.lit(None).cast(log.schema["ts"].dataType)
    end_date, error = {
        UPLOAD_RULE: (_last("ts", by_order), _last("error_msg", by_order)),
        RUN_RULE: (F.max_by("ts", done), _last_set("error_msg", by_order)),
        EVALUATION_RULE: (F.max(no_date), _last_set("error_msg", by_order)),
    }[rule]
    return log.groupBy(*key).agg(
        _last("task_status", by_order).alias("task_status"),
        end_date.alias("end_date"),
        error.alias("error_msg"),
        *[_last_set(f, by_order).alias(f) for f in kept_fields],
    )

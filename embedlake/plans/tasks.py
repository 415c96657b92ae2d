"""Task feed, task state and usage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.operators import tasks as tk
from embedlake.operators.usage import daily_usage as filled_usage
from embedlake.operators.usage import usage_by_tag as by_tag
from embedlake.plans.catalog import query
from embedlake.plans.tables import TODAY, Tables, models, now, task_log, task_tables

TASKS_SQL = """
tasks AS (
  SELECT event_id AS id, event_type, user_id, ts AS created_at, value,
    CASE WHEN value < 2 THEN 'Q' WHEN value < 4 THEN 'R' WHEN value > 100 THEN 'F' ELSE 'D' END AS task_status,
    CASE WHEN value >= 4 THEN ts + to_seconds(round(value * 60)::BIGINT) END AS end_date,
    CASE WHEN value > 100 THEN 'failed after ' || value END AS error_msg
  FROM events),
feed AS (
  SELECT id, CASE event_type WHEN 'click' THEN 'hub/' || user_id WHEN 'view' THEN 'set-' || user_id
      WHEN 'signup' THEN s_name WHEN 'purchase' THEN 'm-' || user_id END AS tag,
    task_status, created_at, end_date, error_msg,
    CASE event_type WHEN 'click' THEN 'model_upload' WHEN 'view' THEN 'dataset_upload'
      WHEN 'error' THEN 'synthesis' WHEN 'signup' THEN 'training' ELSE 'evaluation' END AS task_type
  FROM tasks LEFT JOIN supplier ON event_type = 'signup' AND s_suppkey = user_id)"""

_RECENT = (
    "(task_status IN ('Q', 'R') OR coalesce(end_date, TIMESTAMP '2024-01-31')"
    " >= TIMESTAMP '2024-01-31' - INTERVAL {} HOUR)"
)


@query(
    f"WITH {TASKS_SQL} SELECT * FROM feed WHERE {_RECENT.format(240)} AND task_status IN ('R', 'D', 'F')"
)
def task_feed(t: Tables) -> DataFrame:
    return tk.newest_first(
        tk.task_feed(task_tables(t), now(), 240, models(t), statuses=["R", "D", "F"])
    )


@query(
    f"""WITH {TASKS_SQL} SELECT * FROM feed WHERE {_RECENT.format(720)}
ORDER BY created_at DESC, task_type, id LIMIT 100 OFFSET 50"""
)
def task_feed_page(t: Tables) -> DataFrame:
    """One page of the feed, newest first."""
    return tk.newest_first(tk.task_feed(task_tables(t), now(), 720, models(t)), 100, 50)


@query(
    f"""WITH {TASKS_SQL} SELECT * FROM feed WHERE {_RECENT.format(720)}
AND task_type IN ('training', 'evaluation') AND tag = 'm-8'"""
)
def task_feed_by_tag(t: Tables) -> DataFrame:
    """Two task types, one tag; the other tables are not read."""
    return tk.task_feed(
        task_tables(t), now(), 720, models(t), task_types=["training", "evaluation"], tag="m-8"
    )


def _state_sql(rule: str) -> str:
    end = {
        "upload": "max(ts)",
        "run": "max(ts) FILTER (task_status IN ('D', 'F'))",
        "evaluation": "NULL::TIMESTAMP",
    }[rule]
    error = (
        "max_by(struct_pack(e := error_msg), struct_pack(ts := ts, event_id := event_id)).e"
        if rule == "upload"
        else "max_by(error_msg, struct_pack(ts := ts, event_id := event_id)) FILTER (error_msg IS NOT NULL)"
    )
    return f"""SELECT '{rule}' AS rule, id,
  max_by(task_status, struct_pack(ts := ts, event_id := event_id)) AS task_status, {end} AS end_date,
  {error} AS error_msg,
  max_by(progress, struct_pack(ts := ts, event_id := event_id)) FILTER (progress IS NOT NULL) AS progress
FROM log GROUP BY id"""


LOG_SQL = """
log AS (
  SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'click' THEN 'Q' WHEN 'view' THEN 'R'
      WHEN 'error' THEN 'F' ELSE 'D' END AS task_status,
    CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error_msg,
    CASE WHEN value > 20 THEN value END AS progress FROM events)"""


@query(f"WITH {LOG_SQL} " + " UNION ALL ".join(_state_sql(r) for r in ["upload", "run", "evaluation"]))
def task_state(t: Tables) -> DataFrame:
    """The event log folded under each of the three update rules."""
    states = [
        tk.task_states(task_log(t), rule, order=["ts", "event_id"], kept_fields=["progress"]).select(
            F.lit(rule).alias("rule"), "*"
        )
        for rule in [tk.UPLOAD_RULE, tk.RUN_RULE, tk.EVALUATION_RULE]
    ]
    return states[0].unionByName(states[1]).unionByName(states[2])


USAGE_SQL = """
created AS (SELECT user_id AS ai_model_id, min(ts)::DATE AS first_day FROM events GROUP BY user_id),
spine AS (
  SELECT ai_model_id, unnest(generate_series(first_day, DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day
  FROM created),
counts AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)"""


@query(
    f"""WITH {USAGE_SQL}
SELECT s.ai_model_id, s.day, coalesce(n, 0) AS n FROM spine s
LEFT JOIN counts c ON c.user_id = s.ai_model_id AND c.day = s.day"""
)
def daily_usage(t: Tables) -> DataFrame:
    usage = t.events.select(F.col("user_id").alias("ai_model_id"), F.col("ts").alias("created_at"))
    created = usage.groupBy("ai_model_id").agg(F.min("created_at").alias("created_at"))
    return filled_usage(created, usage, F.expr(TODAY))


@query(
    """WITH wanted AS (SELECT s_name AS model_tag FROM supplier UNION SELECT n_name FROM nation),
counts AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT w.model_tag, s_suppkey IS NOT NULL AS found, day,
       CASE WHEN s_suppkey IS NOT NULL THEN coalesce(n, 0) END AS n
FROM wanted w LEFT JOIN supplier s ON s.s_name = w.model_tag LEFT JOIN counts c ON c.user_id = s.s_suppkey"""
)
def usage_by_tag(t: Tables) -> DataFrame:
    """Daily calls by model tag; tags of no model are reported as not found."""
    wanted = t.supplier.select(F.col("s_name").alias("model_tag")).union(t.nation.select("n_name"))
    known = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("model_tag"))
    calls = t.events.select(F.col("user_id").alias("ai_model_id"), F.col("ts").alias("created_at"))
    return by_tag(wanted, known, calls)

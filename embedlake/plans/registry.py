"""Registry, guard and version queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.functions import text as tx
from embedlake.operators import registry as rg, snapshots
from embedlake.plans.catalog import query
from embedlake.plans.tables import Tables, datasets, models, now, task_tables
from embedlake.session import work_dir

DATASETS_SQL = """
datasets AS (
  SELECT p_partkey AS id, p_size AS version, p_name || '_' || p_partkey AS name,
    'ds_' || p_partkey || '.jsonl' AS file_name,
    CASE WHEN p_size > 25 THEN 'T' ELSE 'D' END AS classification,
    ['H', 'L', 'S'][1 + p_partkey % 3] AS source, p_retailprice AS rows FROM part)"""

MODELS_SQL = """
models AS (
  SELECT s_suppkey AS id, s_name AS model_tag,
    CASE WHEN s_suppkey > 0 THEN s_suppkey // 2 END AS trained_from_id, s_acctbal AS balance
  FROM supplier)"""


def _uuid_sql(text: str) -> str:
    return (
        f"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', "
        "'\\1-\\2-\\3-\\4-\\5')"
    )


@query(
    f"""WITH refs AS (
  SELECT {_uuid_sql("l_partkey::VARCHAR")} AS ref FROM lineitem
  UNION ALL SELECT {_uuid_sql("(o_custkey + 1000000000)::VARCHAR")} FROM orders
  UNION ALL SELECT 'ds-' || s_suppkey FROM supplier),
known AS (SELECT {_uuid_sql("p_partkey::VARCHAR")} AS ref FROM part)
SELECT ref, count(*) AS n_refs,
  CASE WHEN starts_with(ref, 'ds-') THEN 'invalid_id' ELSE 'not_found' END AS reason
FROM refs WHERE ref NOT IN (SELECT ref FROM known) GROUP BY ref"""
)
def missing_refs(t: Tables) -> DataFrame:
    """Dataset references that are no UUID or not registered."""
    part_refs = t.lineitem.select(F.col("l_partkey").alias("id"))
    unknown = t.orders.select((F.col("o_custkey") + 1_000_000_000).alias("id"))
    refs = (
        part_refs.unionByName(unknown)
        .select(rg.minted_id("id").alias("ref"))
        .unionByName(
            t.supplier.select(F.concat(F.lit("ds-"), F.col("s_suppkey").cast("string")).alias("ref"))
        )
    )
    known = datasets(t).select(rg.minted_id("id").alias("dataset_id"))
    return rg.missing_references(refs, known, "ref", "dataset_id")


@query(
    f"""WITH {DATASETS_SQL} SELECT d.id, d.version, d.name FROM datasets d
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = d.id
  AND p.p_size - CASE WHEN p.p_retailprice > 950 THEN 1 ELSE 0 END = d.version)"""
)
def changed_since(t: Tables) -> DataFrame:
    """A client holds every dataset, the dear ones one version behind."""
    behind = F.when(F.col("p_retailprice") > 950, 1).otherwise(0)
    held = t.part.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") - behind).alias("version")
    )
    return rg.changed_since(datasets(t), held, "id", "version").select("id", "version", "name")


@query(
    """WITH updates AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size - 1 END AS expected_version,
    'new ' || p_name AS name, p_partkey AS seq FROM part
  UNION ALL SELECT s_suppkey + 1000000000, 0, s_name, s_suppkey + 1000000000 FROM supplier)
SELECT u.id, u.expected_version,
  CASE WHEN p.p_partkey IS NULL THEN 'not_found' WHEN p.p_size = u.expected_version THEN 'updated'
       ELSE 'version_mismatch' END AS outcome,
  CASE WHEN p.p_size = u.expected_version THEN p.p_size + 1 ELSE p.p_size END AS version_after,
  CASE WHEN p.p_size = u.expected_version THEN u.name ELSE p.p_name || '_' || p.p_partkey END AS name_after
FROM updates u LEFT JOIN part p ON p.p_partkey = u.id"""
)
def optimistic_update(t: Tables) -> DataFrame:
    """Half the updates carry a stale version, some an unknown id."""
    even = F.col("p_partkey") % 2 == 0
    updates = t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(even, F.col("p_size")).otherwise(F.col("p_size") - 1).alias("expected_version"),
        F.concat(F.lit("new "), "p_name").alias("name"),
    ).unionByName(
        t.supplier.select(
            (F.col("s_suppkey") + 1_000_000_000).alias("id"),
            F.lit(0).alias("expected_version"),
            F.col("s_name").alias("name"),
        )
    )
    current = datasets(t).select("id", "version", "name")
    outcome, snapshot = rg.optimistic_update(
        current, updates.withColumn("seq", F.col("id")), ["name"], chained=False
    )
    after = snapshot.select(
        "id", F.col("version").alias("version_after"), F.col("name").alias("name_after")
    )
    return outcome.join(after, "id", "left").select(
        "id", "expected_version", "outcome", "version_after", "name_after"
    )


@query(
    """WITH RECURSIVE ordered AS (
  SELECT o_custkey AS id, o_orderkey % 4 AS expected_version,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
folded AS (
  SELECT c_custkey AS id, 0::BIGINT AS n, 0 AS version FROM customer
  UNION ALL
  SELECT f.id, o.n, f.version + CASE WHEN o.expected_version = f.version THEN 1 ELSE 0 END
  FROM folded f JOIN ordered o ON o.id = f.id AND o.n = f.n + 1)
SELECT id, max(version) AS version FROM folded GROUP BY id"""
)
def chained_updates(t: Tables) -> DataFrame:
    """Every order updates its customer in order; only fresh versions count."""
    updates = t.orders.select(
        F.col("o_custkey").alias("id"),
        (F.col("o_orderkey") % 4).alias("expected_version"),
        F.col("o_orderkey").alias("seq"),
        F.lit(None).cast("string").alias("name"),
    )
    current = t.customer.select(
        F.col("c_custkey").alias("id"), F.lit(0).alias("version"), F.col("c_name").alias("name")
    )
    _, snapshot = rg.optimistic_update(current, updates, ["name"])
    return snapshot.select("id", "version")


@query(
    """WITH log AS (
  SELECT l_partkey AS id, (l_orderkey * 10 + l_linenumber) AS version, l_quantity AS rows FROM lineitem)
SELECT id, max(version) AS version, max_by(rows, (version, rows)) AS rows FROM log GROUP BY id"""
)
def latest_rows(t: Tables) -> DataFrame:
    """Newest snapshot row of each key in an append-only log."""
    version = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    log = t.lineitem.select(
        F.col("l_partkey").alias("id"), version.alias("version"), F.col("l_quantity").alias("rows")
    ).withColumn("place", F.struct("version", "rows"))
    return rg.latest_versions(log, version="place").drop("place")


@query(
    f"""WITH RECURSIVE {MODELS_SQL},
up AS (
  SELECT id, id AS root_id, trained_from_id AS next, 0::BIGINT AS depth FROM models
  UNION ALL
  SELECT up.id, m.id, m.trained_from_id, up.depth + 1 FROM up JOIN models m ON m.id = up.next)
SELECT c.id, c.model_tag, p.model_tag AS parent_tag, u.root_id, u.depth
FROM models c JOIN up u ON u.id = c.id AND u.next IS NULL LEFT JOIN models p ON p.id = c.trained_from_id"""
)
def model_lineage(t: Tables) -> DataFrame:
    """Parent, root and depth of every model."""
    registry = models(t)
    parents = registry.select(
        F.col("id").alias("trained_from_id"), F.col("model_tag").alias("parent_tag")
    )
    return (
        registry.join(rg.lineage(registry), "id")
        .join(parents, "trained_from_id", "left")
        .select("id", "model_tag", "parent_tag", "root_id", "depth")
    )


@query(
    f"""WITH {DATASETS_SQL} SELECT d.id, d.name, e.event_id AS synthesis_id, e.ts AS synthesised_at
FROM datasets d LEFT JOIN events e ON e.event_id = d.id AND e.event_type = 'error'"""
)
def dataset_with_synthesis(t: Tables) -> DataFrame:
    tasks = task_tables(t)["synthesis"].select(
        "id",
        F.col("id").alias("synthesis_id"),
        F.col("created_at").alias("synthesised_at"),
    )
    return datasets(t).join(tasks, "id", "left").select("id", "name", "synthesis_id", "synthesised_at")


@query(
    f"""WITH {DATASETS_SQL},
requests AS (
  SELECT p_partkey AS request_id,
    CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type || '/' || p_size END AS tag FROM part),
running AS (SELECT DISTINCT p_type || '/' || p_size AS tag FROM part WHERE p_retailprice > 950),
stored AS (
  SELECT DISTINCT tag FROM (SELECT DISTINCT tag FROM requests) r
  WHERE EXISTS (SELECT 1 FROM datasets d WHERE d.source = 'H' AND starts_with(d.name, r.tag)))
SELECT request_id, tag, CASE WHEN tag IN (SELECT tag FROM stored) THEN 'already_exists'
  WHEN tag IN (SELECT tag FROM running) THEN 'being_uploaded' ELSE 'admitted' END AS verdict
FROM requests"""
)
def duplicate_guard(t: Tables) -> DataFrame:
    kind = F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"))
    requests = t.part.select(
        F.col("p_partkey").alias("request_id"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(kind).alias("tag"),
    )
    running = t.part.filter("p_retailprice > 950").select(kind.alias("tag"))
    hub = datasets(t).filter("source = 'H'")
    return rg.duplicate_guard(requests, hub, running).select("request_id", "tag", "verdict")


@query(
    r"""WITH found AS (
  SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/?#].*$', '') AS model_dir FROM pages),
registered AS (
  SELECT DISTINCT replace(replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/?#].*$', ''),
    '.', '_'), '-', '_') AS tag FROM pages WHERE starts_with(url, 'https'))
SELECT model_dir, regexp_replace(model_dir, '[^\p{L}\p{N}]', '_', 'g') AS safe_tag,
  regexp_replace(model_dir, '[^\p{L}\p{N}]', '_', 'g') IN (SELECT tag FROM registered) AS exists
FROM found"""
)
def archive_model_guard(t: Tables) -> DataFrame:
    """Hosts as models of an archive; those seen over https are registered."""
    host = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[/?#].*$", "")
    found = t.pages.select(host.alias("model_dir")).distinct()
    secure = t.pages.filter(F.startswith("url", F.lit("https")))
    registry = secure.select(tx.safe_model_name(host).alias("model_tag"))
    return rg.new_and_existing(found, registry, "model_dir", "model_tag").select(
        "model_dir", "safe_tag", "exists"
    )


@query(
    """SELECT 'model' AS kind, s_suppkey AS id, 1::BIGINT AS n FROM supplier WHERE s_acctbal >= 0
UNION ALL
SELECT 'counter', user_id, count(*) FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY user_id"""
)
def delete_cascade(t: Tables) -> DataFrame:
    """Models in debt go, and their usage rows with them."""
    counters = t.events.select("event_id", F.col("user_id").alias("ai_model_id"))
    gone = models(t).filter("balance < 0")
    kept, usage = rg.cascade_delete(models(t), counters, gone, "id", "ai_model_id")
    return kept.select(F.lit("model").alias("kind"), "id", F.lit(1).cast("bigint").alias("n")).unionByName(
        usage.groupBy(F.col("ai_model_id").alias("id"))
        .agg(F.count("*").alias("n"))
        .select(F.lit("counter").alias("kind"), "id", "n")
    )


@query(
    f"""WITH {DATASETS_SQL},
all_rows AS (
  SELECT {_uuid_sql("id::VARCHAR || chr(31) || name")} AS dataset_id, name, source FROM datasets
  UNION ALL
  SELECT {_uuid_sql("s_suppkey::VARCHAR || chr(31) || s_name")}, s_name, 'L' FROM supplier)
SELECT dataset_id, name, source FROM all_rows"""
)
def registry_append(t: Tables) -> DataFrame:
    """Two appends to a registry table, read back."""
    path = work_dir(t.spark, "registry")
    first = datasets(t).select("id", "name", "source")
    second = models(t).select("id", F.col("model_tag").alias("name"), F.lit("L").alias("source"))
    minted = lambda df: df.select(rg.minted_id("id", "name").alias("dataset_id"), "name", "source")
    rg.append(t.spark, path, minted(first))
    return rg.append(t.spark, path, minted(second))


@query(
    f"""WITH {MODELS_SQL}, wanted AS (SELECT DISTINCT user_id AS id FROM events)
SELECT w.id, m.model_tag, m.id IS NOT NULL AS found FROM wanted w LEFT JOIN models m USING (id)"""
)
def point_lookup(t: Tables) -> DataFrame:
    wanted = t.events.select(F.col("user_id").alias("id")).distinct()
    return rg.lookup(wanted, models(t), "id").select("id", "model_tag", "found")


@query(
    f"""WITH {DATASETS_SQL}
SELECT id, name, (SELECT count(*) FROM datasets) AS total,
  (SELECT ceil(count(*) / 50.0)::BIGINT FROM datasets) AS total_pages
FROM datasets ORDER BY id LIMIT 50 OFFSET 100"""
)
def paged_listing(t: Tables) -> DataFrame:
    """The third page of 50."""
    return rg.page_by_number(datasets(t).select("id", "name"), 3, 50)


@query(
    """SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders
ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"""
)
def latest_n(t: Tables) -> DataFrame:
    """The newest 20 of a task list."""
    tasks = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return rg.newest(tasks, 20)


@query(
    f"""WITH {DATASETS_SQL},
requests AS (
  SELECT event_id, CASE WHEN event_id % 4 IN (0, 2) THEN user_id * 20 END AS dataset_id,
    CASE WHEN event_id % 4 IN (1, 2) THEN event_id // 2 END AS training_task_id FROM events),
tasks AS (
  SELECT event_id AS training_task_id,
    CASE WHEN value > 5 THEN 'data/val_' || event_id || '.jsonl' END AS path
  FROM events WHERE event_type IN ('signup', 'view'))
SELECT r.event_id, r.dataset_id, r.training_task_id,
  CASE WHEN r.dataset_id IS NOT NULL AND r.training_task_id IS NOT NULL THEN NULL
       WHEN r.dataset_id IS NOT NULL THEN 'data/datasets/' || d.file_name ELSE t.path END AS dataset_path,
  CASE WHEN r.dataset_id IS NOT NULL THEN
         coalesce('Dataset: ' || d.file_name, 'Dataset ID: ' || r.dataset_id)
       WHEN r.training_task_id IS NOT NULL THEN 'Training validation set: ' || r.training_task_id
  END AS dataset_info,
  CASE WHEN r.dataset_id IS NOT NULL AND r.training_task_id IS NOT NULL THEN 'both given'
       WHEN r.dataset_id IS NULL AND r.training_task_id IS NULL THEN 'none given'
       WHEN r.dataset_id IS NOT NULL AND d.id IS NULL THEN 'dataset not found'
       WHEN r.training_task_id IS NOT NULL AND t.training_task_id IS NULL THEN 'training task not found'
       WHEN r.training_task_id IS NOT NULL AND t.path IS NULL THEN 'no validation dataset' END AS error
FROM requests r LEFT JOIN datasets d ON d.id = r.dataset_id
LEFT JOIN tasks t ON t.training_task_id = r.training_task_id"""
)
def resolve_eval_dataset(t: Tables) -> DataFrame:
    slot = F.col("event_id") % 4
    requests = t.events.select(
        "event_id",
        F.when(slot.isin(0, 2), F.col("user_id") * 20).alias("dataset_id"),
        F.when(slot.isin(1, 2), F.floor(F.col("event_id") / 2)).alias("training_task_id"),
    )
    path = F.concat(F.lit("data/val_"), F.col("event_id").cast("string"), F.lit(".jsonl"))
    tasks = t.events.filter("event_type in ('signup', 'view')").select(
        F.col("event_id").alias("training_task_id"),
        F.when(F.col("value") > 5, path).alias("validation_dataset_path"),
    )
    known = datasets(t).select(F.col("id").alias("dataset_id"), "file_name")
    return rg.resolve_evaluation_dataset(requests, known, tasks)


@query(
    """WITH tags AS (
  SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'models/' WHEN 1 THEN 'trained_models/'
    WHEN 2 THEN 'models--org_' WHEN 3 THEN 'org_finetuned_' ELSE 'org_name_' END || s_name AS tag FROM supplier),
normal AS (
  SELECT *, CASE WHEN starts_with(tag, 'trained_models/') OR starts_with(tag, 'models/')
    OR contains(tag, 'finetuned') THEN tag
    WHEN starts_with(replace(tag, '_', '--'), 'models--') THEN replace(tag, '_', '--')
    ELSE 'models--' || replace(tag, '_', '--') END AS model_dir FROM tags)
SELECT s_suppkey, tag, model_dir,
  replace(regexp_replace(model_dir, '^models--', ''), '--', '-') || '-finetuned-20240131-000000-'
    || left(md5(s_suppkey::VARCHAR), 8) AS output_name
FROM normal"""
)
def model_tag_normalize(t: Tables) -> DataFrame:
    starts = ["models/", "trained_models/", "models--org_", "org_finetuned_", "org_name_"]
    start = F.element_at(F.array(*map(F.lit, starts)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    tags = t.supplier.select("s_suppkey", F.concat(start, "s_name").alias("tag"))
    named = tags.withColumn("model_dir", tx.normalized_model_tag(F.col("tag")))
    task = F.md5(F.col("s_suppkey").cast("string"))
    return named.withColumn("output_name", tx.finetuned_name(F.col("model_dir"), now(), task))


@query(
    """WITH raw AS (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Q' WHEN 1 THEN 'running' WHEN 2 THEN 'Done'
    WHEN 3 THEN 'FAILED' WHEN 4 THEN 'd' ELSE o_orderstatus END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN raw IN ('Q', 'R', 'D', 'F') THEN raw WHEN upper(raw) = 'QUEUED' THEN 'Q'
  WHEN upper(raw) = 'RUNNING' THEN 'R' WHEN upper(raw) = 'DONE' THEN 'D' ELSE 'F' END AS task_status,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::INTEGER END AS expected_version
FROM raw"""
)
def status_decode(t: Tables) -> DataFrame:
    """Status codes and names; version headers with and without quotes."""
    known = F.array(*map(F.lit, ["Q", "running", "Done", "FAILED", "d"]))
    slot = (F.col("o_orderkey") % 6 + 1).cast("int")
    raw = F.coalesce(F.try_element_at(known, slot), F.col("o_orderstatus"))
    key = F.col("o_orderkey").cast("string")
    header = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(' "'), key, F.lit('"'))).otherwise(key)
    return t.orders.select(
        "o_orderkey",
        tx.decoded_status(raw).alias("task_status"),
        tx.expected_version(header).alias("expected_version"),
    )


@query(
    """SELECT 'order ' || o_orderkey AS id, o_totalprice, (SELECT count(*) FROM orders) AS total
FROM orders ORDER BY id LIMIT 70 OFFSET (SELECT count(*) - 100 FROM orders)"""
)
def paged_far_strings(t: Tables) -> DataFrame:
    """A page near the end of a listing with text ids."""
    listing = t.orders.select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("id"), "o_totalprice"
    )
    return rg.page_by_offset(listing, 70, listing.count() - 100)


_PAGES_SQL = """SELECT '{page}' AS page, 'order ' || o_orderkey AS id, o_totalprice, (SELECT count(*) FROM orders) AS total
FROM (SELECT * FROM orders ORDER BY 'order ' || o_orderkey LIMIT 40 OFFSET {offset})"""


@query(
    _PAGES_SQL.format(page="near", offset=20)
    + " UNION ALL "
    + _PAGES_SQL.format(page="far", offset="(SELECT count(*) * 2 // 3 FROM orders)")
)
def stored_pages(t: Tables) -> DataFrame:
    """A near and a far page of a stored listing with text ids."""
    path = work_dir(t.spark, "listing")
    listing = t.orders.select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("id"), "o_totalprice"
    )
    rg.write_listing(listing, path, range_rows=2_000)
    pages = {"near": 20, "far": listing.count() * 2 // 3}
    found = [rg.read_page(t.spark, path, 40, offset).select(F.lit(name).alias("page"), "*") for name, offset in pages.items()]
    return found[0].unionByName(found[1])


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS version,
  CASE WHEN p_partkey % 6 = 0 THEN 'new ' || p_name ELSE p_name || '_' || p_partkey END AS name
FROM part WHERE p_partkey % 5 <> 0"""
)
def stored_updates(t: Tables) -> DataFrame:
    """A stored table after updates, half of them stale, and deletes."""
    path = work_dir(t.spark, "snapshot")
    snapshots.create(datasets(t).select("id", "version", "name"), path)
    every_third = t.part.where("p_partkey % 3 = 0")
    updates = every_third.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") - 1).alias("expected_version"),
        F.concat(F.lit("new "), "p_name").alias("name"),
        F.col("p_partkey").alias("seq"),
    )
    snapshots.update(t.spark, path, updates, ["name"], chained=False)
    snapshots.delete(t.spark, path, t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id")))
    return snapshots.read(t.spark, path)

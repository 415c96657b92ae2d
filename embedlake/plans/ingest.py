"""Ingest, cell-check, naming, archive and synthesis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.functions import text as tx
from embedlake.operators import archives, canonical as cn, synthesis as sy
from embedlake.plans.catalog import query
from embedlake.plans.tables import Tables, archive_members, text_triplets
from embedlake.plans.training import TEXT_TRIPLETS_SQL
from embedlake.session import work_dir
from embedlake.sources.files import Ingested, ingest, inspect, list_files, scan_subsets
from embedlake.sources.jsonl import canonical_lines, flatten, write_json_files
from embedlake.sources.splits import RANGE_BYTES


@query(
    """WITH counted AS (
  SELECT doc_id, text, left(text, 1024) AS head FROM documents),
n AS (
  SELECT doc_id,
    length(head) - length(replace(head, ',', '')) AS c1,
    length(head) - length(replace(head, ';', '')) AS c2,
    length(head) - length(replace(head, chr(9), '')) AS c3,
    length(head) - length(replace(head, '|', '')) AS c4,
    length(text) - length(replace(text, ',', '')) AS w1,
    length(text) - length(replace(text, ';', '')) AS w2,
    length(text) - length(replace(text, chr(9), '')) AS w3,
    length(text) - length(replace(text, '|', '')) AS w4 FROM counted)
SELECT doc_id,
  CASE WHEN greatest(c1, c2, c3, c4) = 0 THEN ';' WHEN c1 = greatest(c1, c2, c3, c4) THEN ','
       WHEN c2 = greatest(c1, c2, c3, c4) THEN ';' WHEN c3 = greatest(c1, c2, c3, c4) THEN chr(9)
       ELSE '|' END AS delimiter,
  CASE WHEN greatest(w1, w2, w3, w4) = 0 THEN ';' WHEN w1 = greatest(w1, w2, w3, w4) THEN ','
       WHEN w2 = greatest(w1, w2, w3, w4) THEN ';' WHEN w3 = greatest(w1, w2, w3, w4) THEN chr(9)
       ELSE '|' END AS whole_text_delimiter
FROM n"""
)
def csv_delimiter_detect(t: Tables) -> DataFrame:
    """Delimiter by the sampling rule, and by the whole text."""
    return t.documents.select(
        "doc_id",
        tx.delimiter(F.col("text")).alias("delimiter"),
        tx.delimiter(F.col("text"), sample_chars=None).alias("whole_text_delimiter"),
    )


@query(
    """SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty_file'
  WHEN doc_id % 11 = 0 THEN 'unsupported_format'
  WHEN doc_id % 11 <> 1 AND (contains(lower(text), '=cmd') OR contains(lower(text), '=sum')
    OR contains(text, '@') OR contains(lower(text), '=importxml')) THEN 'malicious_content' END AS verdict
FROM documents"""
)
def formula_gate(t: Tables) -> DataFrame:
    """Content gates over whole texts; file types vary by document."""
    kind = (
        F.when(F.col("doc_id") % 11 == 0, "txt").when(F.col("doc_id") % 11 == 1, "xlsx").otherwise("csv")
    )
    return t.documents.select(
        "doc_id", tx.content_verdict(F.col("text"), kind, header_bytes=None).alias("verdict")
    )


_CELL_STARTS = ["", "=", " +", "\t-", "@", "x="]


@query(
    """WITH cells AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '=' WHEN 2 THEN ' +'
    WHEN 3 THEN chr(9) || '-' WHEN 4 THEN '@' ELSE 'x=' END || text AS cell FROM documents)
SELECT doc_id, md5(CASE WHEN ltrim(cell, E' \\t\\n\\r\\f\\v') <> ''
    AND left(ltrim(cell, E' \\t\\n\\r\\f\\v'), 1) IN ('=', '+', '-', '@')
  THEN '''' || cell ELSE cell END) AS escaped_md5,
  left(ltrim(cell, E' \\t\\n\\r\\f\\v'), 1) IN ('=', '+', '-', '@') AS was_escaped
FROM cells"""
)
def formula_escape(t: Tables) -> DataFrame:
    start = F.element_at(
        F.array(*map(F.lit, _CELL_STARTS)), (F.col("doc_id") % 6 + 1).cast("int")
    )
    cells = t.documents.select("doc_id", F.concat(start, "text").alias("cell"))
    escaped = cn.escape_formulas(cells.withColumn("raw", F.col("cell")), ["cell"])
    return escaped.select(
        "doc_id",
        F.md5("cell").alias("escaped_md5"),
        (F.col("cell") != F.col("raw")).alias("was_escaped"),
    )


@query(
    """WITH cells AS (
  SELECT 'documents' AS source_table, doc_id AS row_id, text AS cell FROM documents
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'events', event_id, props FROM events
  UNION ALL SELECT 'events_list', event_id, '"' || event_type || ',' || value::BIGINT || '"' FROM events
  UNION ALL SELECT 'events_open', event_id, event_type || '"' FROM events
  UNION ALL SELECT 'parts', p_partkey, p_name || '""' FROM part),
checked AS (
  SELECT *, length(cell) - length(replace(cell, '"', '')) AS quotes,
         starts_with(cell, '"') AND ends_with(cell, '"') AS wrapped FROM cells),
named AS (
  SELECT *, CASE WHEN quotes % 2 = 1 THEN 'unbalanced_quotes'
    WHEN contains(cell, '""') AND NOT wrapped THEN 'double_quotes'
    WHEN NOT wrapped AND regexp_matches(cell, '[,;|\\n\\r]') THEN 'special_characters' END AS violation
  FROM checked)
SELECT source_table, row_id, 'cell' AS column_name, violation, left(cell, 50) AS shown
FROM named WHERE violation IS NOT NULL"""
)
def cell_violations(t: Tables) -> DataFrame:
    def cells(df: DataFrame, table: str, row_id, cell) -> DataFrame:
        return df.select(F.lit(table).alias("source_table"), row_id.alias("row_id"), cell.alias("cell"))

    c = F.col
    listed = F.concat(
        F.lit('"'), c("event_type"), F.lit(","), F.rint("value").cast("bigint").cast("string"), F.lit('"')
    )
    union = (
        cells(t.documents, "documents", c("doc_id"), c("text"))
        .unionByName(cells(t.conversations, "conversations", c("conv_id") * 1000 + c("turn"), c("text")))
        .unionByName(cells(t.events, "events", c("event_id"), c("props")))
        .unionByName(cells(t.events, "events_list", c("event_id"), listed))
        .unionByName(cells(t.events, "events_open", c("event_id"), F.concat("event_type", F.lit('"'))))
        .unionByName(cells(t.part, "parts", c("p_partkey"), F.concat("p_name", F.lit('""'))))
    )
    return cn.cell_violations(union, ["source_table", "row_id"], ["cell"])


@query(
    f"""WITH {TEXT_TRIPLETS_SQL}
SELECT conv_id, turn, question, positive, negative, 'T' AS classification FROM text_triplets"""
)
def canonicalize_triples(t: Tables) -> DataFrame:
    """Headers by alias, whatever their case; the spare column goes."""
    raw = text_triplets(t).select(
        "conv_id",
        "turn",
        F.col("negative").alias("rejected"),
        F.col("positive").alias("CHOSEN"),
        F.col("question").alias("Prompt"),
        F.col("dataset").alias("spare"),
    )
    return cn.canonicalize(raw, keep=["conv_id", "turn"])


@query(
    "SELECT doc_id, source AS question, text AS positive, 'D' AS classification FROM documents"
)
def canonicalize_custom(t: Tables) -> DataFrame:
    """Explicit column names, no negatives."""
    return cn.canonicalize(
        t.documents, {"question": "Source", "positive": "text", "negative": None}, keep=["doc_id"]
    )


_FIRST_COLUMNS = [[c] for c in "prompt instruction query question input system context human text unknown".split()]
_OTHER_COLUMNS = [
    ["chosen", "rejected"],
    ["chosen"],
    ["output"],
    ["positive", "negative"],
    ["response_a", "response_b"],
    ["answer"],
    ["assistant"],
    ["user", "chosen", "rejected", "extra"],
    ["question", "chosen", "rejected"],
]


def _sql_lists(rows: list[list[str]]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in r) + "]" for r in rows) + "]"


@query(
    f"""WITH cols AS (
  SELECT doc_id, list_concat({_sql_lists(_FIRST_COLUMNS)}[1 + n_chars % {len(_FIRST_COLUMNS)}],
    {_sql_lists(_OTHER_COLUMNS)}[1 + doc_id % {len(_OTHER_COLUMNS)}]) AS columns FROM documents),
schemas AS (
  SELECT unnest(range({len(cn.ALLOWED_SCHEMAS)})) AS ordinal,
         unnest({_sql_lists(cn.ALLOWED_SCHEMAS)}) AS names),
first_match AS (
  SELECT doc_id, min(ordinal) AS ordinal FROM cols, schemas
  WHERE list_has_all(columns, names) GROUP BY doc_id)
SELECT c.doc_id, s.ordinal::INTEGER AS schema_ordinal, s.names[1] AS question_column,
       s.names[2] AS positive_column, s.names[3] AS negative_column,
       CASE WHEN s.names[3] IS NOT NULL THEN 'T' WHEN s.ordinal IS NOT NULL THEN 'D' END AS classification
FROM cols c LEFT JOIN first_match f USING (doc_id) LEFT JOIN schemas s ON s.ordinal = f.ordinal"""
)
def schema_match(t: Tables) -> DataFrame:
    def pick(rows: list[list[str]], index) -> F.Column:
        lists = F.array(*[F.array(*map(F.lit, r)) for r in rows])
        return F.element_at(lists, (index % len(rows) + 1).cast("int"))

    columns = F.concat(
        pick(_FIRST_COLUMNS, F.col("n_chars")), pick(_OTHER_COLUMNS, F.col("doc_id"))
    )
    return cn.match_schema(t.documents.select("doc_id", columns.alias("columns"))).drop("columns")


@query(
    f"""WITH {TEXT_TRIPLETS_SQL},
blanked AS (
  SELECT dataset, question, negative, CASE WHEN turn = 1 THEN E' \\n' ELSE positive END AS positive
  FROM text_triplets),
counted AS (
  SELECT dataset, count(*) AS num_rows,
    count(*) FILTER (question IS NULL) AS null_question,
    count(*) FILTER (trim(question, E' \\n\\t\\r') = '') AS blank_question,
    count(*) FILTER (positive IS NULL) AS null_positive,
    count(*) FILTER (trim(positive, E' \\n\\t\\r') = '') AS blank_positive,
    count(*) FILTER (negative IS NULL) AS null_negative,
    count(*) FILTER (trim(negative, E' \\n\\t\\r') = '') AS blank_negative,
    count(*) FILTER (trim(question, E' \\n\\t\\r') <> '' AND trim(positive, E' \\n\\t\\r') <> ''
      AND trim(negative, E' \\n\\t\\r') <> '') AS valid_rows
  FROM blanked GROUP BY dataset)
SELECT *, CASE WHEN null_question > 0 THEN 'Column ''question'' contains ' || null_question || ' null values'
  WHEN null_positive > 0 THEN 'Column ''positive'' contains ' || null_positive || ' null values'
  WHEN null_negative > 0 THEN 'Column ''negative'' contains ' || null_negative || ' null values'
  WHEN blank_question > 0 THEN 'Column ''question'' contains ' || blank_question || ' empty values'
  WHEN blank_positive > 0 THEN 'Column ''positive'' contains ' || blank_positive || ' empty values'
  WHEN blank_negative > 0 THEN 'Column ''negative'' contains ' || blank_negative || ' empty values'
  END AS error FROM counted"""
)
def triplet_validate(t: Tables) -> DataFrame:
    blanked = F.when(F.col("turn") == 1, F.lit(" \n")).otherwise(F.col("positive"))
    return cn.validation_report(text_triplets(t).withColumn("positive", blanked), ["dataset"])


@query(
    f"""WITH {TEXT_TRIPLETS_SQL}
SELECT conv_id, turn,
  replace(replace(to_json({{question: replace(question, '. ', '.' || chr(8232)),
    positive: replace(positive, ', ', ',' || chr(8233)), negative: negative}})::VARCHAR,
    chr(8232), '\\u2028'), chr(8233), '\\u2029') AS line
FROM text_triplets"""
)
def canonical_jsonl_lines(t: Tables) -> DataFrame:
    """JSON lines of triplets with line and paragraph separators in the text."""
    marked = text_triplets(t).withColumns(
        {
            "question": F.replace(F.col("question"), F.lit(". "), F.lit(".\u2028")),
            "positive": F.replace(F.col("positive"), F.lit(", "), F.lit(",\u2029")),
        }
    )
    return canonical_lines(marked, keep=["conv_id", "turn"]).withColumnRenamed("value", "line")


@query(
    """WITH parts AS (
  SELECT doc_id, 'org/' || source AS tag,
    CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'validation' END AS split,
    CASE WHEN lang = 'en' THEN 'default' ELSE lang END AS subset FROM documents)
SELECT doc_id, tag || CASE WHEN split IS NULL THEN '' ELSE '_' || split END
    || CASE WHEN subset = 'default' THEN '' ELSE '_' || subset END AS dataset_name,
  replace(tag, '/', '_') || CASE WHEN split IS NULL THEN '' ELSE '_' || split END
    || CASE WHEN subset = 'default' THEN '' ELSE '_' || subset END || '.jsonl' AS file_name
FROM parts"""
)
def subset_split_naming(t: Tables) -> DataFrame:
    split = (
        F.when(F.col("doc_id") % 4 == 0, "train")
        .when(F.col("doc_id") % 4 == 1, "test")
        .when(F.col("doc_id") % 4 == 2, "validation")
    )
    subset = F.when(F.col("lang") == "en", "default").otherwise(F.col("lang"))
    names = tx.dataset_names(F.concat(F.lit("org/"), "source"), split, subset)
    return t.documents.select("doc_id", *[c.alias(n) for n, c in names.items()])


_FAILS_SQL = """
verdicts AS (
  SELECT source, CASE WHEN contains(text, '@') OR contains(lower(text), '=sum')
    OR contains(lower(text), '=cmd') OR contains(lower(text), '=importxml') THEN 'malicious_content'
    WHEN lang <> 'en' AND source = 'src3' THEN 'unsupported_format' END AS error FROM documents)"""


@query(
    f"""WITH {_FAILS_SQL}, counted AS (
  SELECT source, count(*) FILTER (error IS NULL) AS uploaded,
         count(*) FILTER (error IS NOT NULL) AS failed FROM verdicts GROUP BY source)
SELECT source, uploaded, failed, CASE WHEN uploaded > 0 THEN 'D' ELSE 'F' END AS task_status,
       CASE WHEN uploaded = 0 THEN 'No valid files could be processed' END AS error_msg
FROM counted"""
)
def ingest_outcome(t: Tables) -> DataFrame:
    """Documents are the files, their source is the upload task."""
    kind = F.when((F.col("lang") != "en") & (F.col("source") == "src3"), "txt").otherwise("csv")
    error = tx.content_verdict(F.col("text"), kind, header_bytes=None)
    return sy.ingest_outcome(t.documents.select("source", error.alias("error")), "source")


_MEMBERS_SQL = """
members AS (
  SELECT page_id, page_id // 50 AS archive,
    regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/f' || page_id || '.'
      || ['bin', 'json', 'txt', 'Safetensors', 'csv'][1 + page_id % 5] AS member,
    strlen(html)::BIGINT AS file_size,
    floor(strlen(html) / (page_id % 120 + 1))::BIGINT AS compress_size
  FROM pages)"""


@query(
    f"""WITH {_MEMBERS_SQL}, counted AS (
  SELECT archive, count(*) AS n_members, sum(file_size)::BIGINT AS total_bytes,
    max(file_size / greatest(compress_size, 1)) FILTER (file_size > 0) AS max_ratio, count(*) AS n_usable
  FROM members GROUP BY archive)
SELECT archive, n_members, total_bytes, round(max_ratio, 6) AS max_ratio, n_usable,
  CASE WHEN n_members > 10000 THEN 'too_many_files' WHEN total_bytes > 53687091200 THEN 'too_large'
       WHEN max_ratio > 100 THEN 'suspicious_ratio' ELSE 'ok' END AS verdict
FROM counted"""
)
def archive_limits(t: Tables) -> DataFrame:
    return archives.archive_limits(archive_members(t)).withColumn(
        "max_ratio", F.round("max_ratio", 6)
    )


@query(
    f"""WITH {_MEMBERS_SQL},
found AS (
  SELECT DISTINCT archive, regexp_replace(member, '/[^/]*$', '') AS model_dir FROM members
  WHERE regexp_matches(lower(member), '\\.(pt|pth|bin|model|safetensors)$')),
outer_dirs AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found o WHERE o.archive = f.archive AND starts_with(f.model_dir, o.model_dir || '/'))),
grouped AS (
  SELECT m.archive, m.member, d.model_dir FROM members m
  JOIN outer_dirs d ON d.archive = m.archive AND starts_with(m.member, d.model_dir || '/')
  UNION ALL
  SELECT archive, member, split_part(member, '/', 1) FROM members
  WHERE archive NOT IN (SELECT archive FROM outer_dirs)),
parents AS (
  SELECT archive, model_dir, arg_min(dir, (length(dir), dir)) AS common_prefix FROM (
    SELECT archive, model_dir, regexp_replace(member, '/[^/]*$', '') AS dir FROM grouped)
  GROUP BY archive, model_dir)
SELECT archive, model_dir, member, common_prefix,
  CASE WHEN regexp_matches(lower(member), '\\.(pt|pth|bin|model|safetensors|json)$') THEN
    CASE WHEN starts_with(member, common_prefix || '/') THEN substr(member, length(common_prefix) + 2)
         ELSE regexp_extract(member, '[^/]*$') END END AS target
FROM grouped JOIN parents USING (archive, model_dir)"""
)
def toplevel_dirs(t: Tables) -> DataFrame:
    return archives.extraction_plan(archives.toplevel_directories(archive_members(t)))


@query(
    """WITH names AS (
  SELECT page_id, regexp_extract(url || ['.csv', ' (1).XLSX', '.txt', '', '.x.jsonl'][1 + page_id % 5],
    '[^/]*$') AS name FROM pages),
parts AS (
  SELECT page_id, name, regexp_extract(name, '^(.+)\\.([^.]*)$', 2) AS raw_ext,
    CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.([^.]*)$', 1)
         ELSE name END AS stem FROM names),
checked AS (
  SELECT *, lower(raw_ext) AS extension, CASE WHEN stem = '' OR raw_ext = '' THEN 'filename_missing'
    WHEN lower(raw_ext) NOT IN ('csv', 'json', 'jsonl', 'xml', 'xlsx', 'xls') THEN 'unsupported_format'
    WHEN length(stem) > 255 THEN 'filename_too_long' END AS name_error FROM parts)
SELECT page_id, extension, name_error,
  CASE WHEN name_error IS NULL THEN regexp_replace(stem, '[^A-Za-z0-9_-]', '_', 'g') || '.' || extension
    END AS file_name,
  regexp_replace(name, '[^\\p{L}\\p{N}]', '_', 'g') AS model_name,
  extension IN ('csv', 'tsv', 'jsonl') AS trainable
FROM checked"""
)
def name_sanitize(t: Tables) -> DataFrame:
    ends = F.array(*map(F.lit, [".csv", " (1).XLSX", ".txt", "", ".x.jsonl"]))
    path = F.concat("url", F.element_at(ends, (F.col("page_id") % 5 + 1).cast("int")))
    named = t.pages.select("page_id", path.alias("path"))
    columns = tx.sanitized_name(F.col("path"))
    return named.select(
        "page_id",
        *[c.alias(n) for n, c in columns.items()],
        tx.safe_model_name(tx.base_name(F.col("path"))).alias("model_name"),
        columns["extension"].isin(tx.TRAINING_EXTENSIONS).alias("trainable"),
    )


@query(
    """WITH sized AS (
  SELECT doc_id, n_chars * (1024 ** (doc_id % 4))::BIGINT AS size FROM documents)
SELECT doc_id, size, CASE WHEN size >= 1073741824 THEN printf('%.2f GB', size / 1073741824.0::DOUBLE)
  WHEN size >= 1048576 THEN printf('%.2f MB', size / 1048576.0::DOUBLE)
  WHEN size >= 1024 THEN printf('%.2f KB', size / 1024.0::DOUBLE) ELSE size || ' bytes' END AS shown
FROM sized"""
)
def size_format(t: Tables) -> DataFrame:
    factor = F.pow(F.lit(1024), F.col("doc_id") % 4).cast("bigint")
    sized = t.documents.select("doc_id", (F.col("n_chars") * factor).alias("size"))
    return sized.withColumn("shown", tx.readable_size(F.col("size")))


@query(
    """WITH nested AS (SELECT event_id, event_type, value, (props::JSON->>'k')::BIGINT AS k FROM events)
SELECT event_id AS id, k AS meta_k, event_type AS meta_tag_kind, value AS meta_tag_value,
       k + 1 AS meta_tag_deep_next FROM nested"""
)
def json_flatten(t: Tables) -> DataFrame:
    """Nested JSON text to flat columns."""
    schema = (
        "id bigint, meta struct<k: bigint, tag: struct<kind: string, value: double, "
        "deep: struct<next: bigint>>>"
    )
    k = F.get_json_object("props", "$.k").cast("bigint")
    nested = F.struct(
        F.col("event_id").alias("id"),
        F.struct(
            k.alias("k"),
            F.struct(
                F.col("event_type").alias("kind"),
                "value",
                F.struct((k + 1).alias("next")).alias("deep"),
            ).alias("tag"),
        ).alias("meta"),
    )
    raw = t.events.select(F.to_json(nested).alias("line"))
    return flatten(raw.select(F.from_json("line", schema).alias("row")).select("row.*"), "_")


@query(
    """WITH files AS (
  SELECT page_id, ['pdf', 'png', 'JPG', 'gif', 'jpeg'][1 + page_id % 5] AS ext, strlen(html) AS length FROM pages)
SELECT page_id, CASE WHEN ext = 'gif' THEN 'unsupported_format' WHEN length > 5000 THEN 'file_too_large' END AS error
FROM files"""
)
def media_gate(t: Tables) -> DataFrame:
    """Which media files an upload takes, by suffix and size."""
    kinds = F.array(*map(F.lit, ["pdf", "png", "JPG", "gif", "jpeg"]))
    path = F.concat(
        F.regexp_replace("url", "[?#].*$", ""),
        F.lit("_"),
        F.col("page_id").cast("string"),
        F.lit("."),
        F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int")),
    )
    error = sy.media_error(path, F.octet_length("html"), max_bytes=5000)
    return t.pages.select("page_id", error.alias("error"))


_ESCAPED = """CASE WHEN left(ltrim(text, E' \\t\\n\\r\\f\\v'), 1) IN ('=', '+', '-', '@')
  THEN '''' || text ELSE text END"""


def _dataset(t: Tables) -> DataFrame:
    return t.documents.select(F.col("text").alias("prompt"), F.col("source").alias("chosen"), F.col("lang").alias("rejected"))


def _counted(read: Ingested) -> DataFrame:
    """Every row read, as its digest; a refused file is a row with its reason."""
    rejected = read.files.filter(F.col("error").isNotNull()).select(F.col("error").alias("question_md5"))
    found = read.rows.select(F.md5("question").alias("question_md5"), "positive", "negative", "classification")
    found = found.unionByName(rejected, allowMissingColumns=True)
    return found.groupBy(*found.columns).agg(F.count("*").alias("n"))


def _round_trip(t: Tables, kind: str, range_bytes: int = RANGE_BYTES, rows: DataFrame | None = None, **options: str) -> DataFrame:
    """Documents written as files of a kind and read again as a dataset."""
    folder = work_dir(t.spark, kind)
    (_dataset(t) if rows is None else rows).write.format(kind).options(**options).save(folder)
    files = list_files(t.spark, folder).filter(tx.extension(tx.base_name(F.col("path"))) == kind)
    return _counted(ingest(t.spark, files, range_bytes=range_bytes))


def _round_trip_sql(text: str) -> str:
    return f"""SELECT md5({text}) AS question_md5, source AS positive, lang AS negative, 'T' AS classification,
  count(*) AS n FROM documents GROUP BY ALL"""


@query(_round_trip_sql(_ESCAPED))
def csv_round_trip(t: Tables) -> DataFrame:
    """Quotes, line breaks and umlauts through CSV files."""
    return _round_trip(t, "csv", header="true", quote='"', escape='"')


# Small ranges, so that every scale has records, strings and characters that a range cuts.
SMALL_RANGES = 1 << 18


@query(_round_trip_sql(_ESCAPED))
def csv_ranges_round_trip(t: Tables) -> DataFrame:
    """One CSV file with line breaks inside quotes, read by many tasks."""
    return _round_trip(t, "csv", SMALL_RANGES, _dataset(t).coalesce(1), header="true", quote='"', escape='"')


_LATIN = f"regexp_replace({_ESCAPED}, '[^\\x00-\\xFF]', '?', 'g')"


@query(_round_trip_sql(_LATIN))
def latin_csv_round_trip(t: Tables) -> DataFrame:
    """Files in Latin-1; what the charset lacks is written as a question mark."""
    return _round_trip(t, "csv", SMALL_RANGES, header="true", quote='"', escape='"', encoding="ISO-8859-1")


def _json_round_trip(t: Tables, layout: str) -> DataFrame:
    files = write_json_files(_dataset(t), work_dir(t.spark, layout), layout)
    return _counted(ingest(t.spark, files, range_bytes=SMALL_RANGES))


@query(_round_trip_sql("text"))
def json_array_round_trip(t: Tables) -> DataFrame:
    """Arrays of objects, cut into records by many tasks."""
    return _json_round_trip(t, "array")


@query(_round_trip_sql("text"))
def json_envelope_round_trip(t: Tables) -> DataFrame:
    """Objects whose key `data` holds the records."""
    return _json_round_trip(t, "envelope")


@query(_round_trip_sql("text"))
def jsonl_round_trip(t: Tables) -> DataFrame:
    """JSON lines, as datasets are stored."""
    return _json_round_trip(t, "lines")


@query(_round_trip_sql("text"))
def xml_round_trip(t: Tables) -> DataFrame:
    """Records of XML files, whatever their columns."""
    return _round_trip(t, "xml", rowTag="record", rootTag="data")


@query(
    """SELECT source, lang, bool_or(contains(lower(text), '=cmd') OR contains(lower(text), '=sum') OR contains(text, '@')
  OR contains(lower(text), '=importxml')) AS malicious,
  CASE WHEN bool_or(regexp_matches(text, '[\\x{80}-\\x{FF}]')) THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding
FROM documents GROUP BY source, lang"""
)
def strict_file_gates(t: Tables) -> DataFrame:
    """Charset and formula patterns of Latin-1 files, wherever in a file they stand."""
    folder = work_dir(t.spark, "gates")
    rows = t.documents.select("text", "source", "lang")
    rows.write.partitionBy("source", "lang").options(encoding="ISO-8859-1", quote='"', escape='"').csv(folder)
    files = list_files(t.spark, folder).filter(tx.extension(tx.base_name(F.col("path"))) == "csv")
    seen = inspect(files, strict=True)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    return seen.groupBy(part("source"), part("lang")).agg(
        F.bool_or(F.coalesce(F.col("error") == "malicious_content", F.lit(False))).alias("malicious"),
        F.min("encoding").alias("encoding"),
    )


@query(
    """SELECT 'hub/orders_' || o_orderstatus || '_' || CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset_name,
  o_orderpriority AS question, o_orderkey::VARCHAR AS positive,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR END AS negative,
  CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'D' END AS classification FROM orders"""
)
def subset_scan(t: Tables) -> DataFrame:
    """Two subsets with different columns, a split per order status."""
    folder = work_dir(t.spark, "subsets")
    rows = t.orders.withColumnRenamed("o_orderstatus", "split")
    key = F.col("o_orderkey").cast("string")
    even = rows.filter("o_orderkey % 2 = 0").select(
        "split", F.col("o_orderpriority").alias("query"), key.alias("chosen"), F.col("o_custkey").cast("string").alias("rejected")
    )
    odd = rows.filter("o_orderkey % 2 <> 0").select("split", F.col("o_orderpriority").alias("input"), key.alias("output"))
    even.write.partitionBy("split").json(f"{folder}/subset=even")
    odd.write.partitionBy("split").json(f"{folder}/subset=odd")
    found = scan_subsets(t.spark, folder, "hub/orders")
    return found.select("dataset_name", "question", "positive", "negative", "classification")

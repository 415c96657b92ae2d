"""Column resolution, schema matching and triplet validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.functions.text import cell_violation, escape_formula

ROLES = ["question", "positive", "negative"]

# Header names accepted for each role, best first.
ALIASES = {
    "question": ["anchor", "q", "query", "prompt"],
    "positive": ["answer", "chosen"],
    "negative": ["random", "rejected", "no_context"],
}

# Allowed column sets of hub datasets, in matching order.
ALLOWED_SCHEMAS = [
    ["prompt", "chosen", "rejected"],
    ["prompt", "chosen_response", "rejected_response"],
    ["prompt", "response_chosen", "response_rejected"],
    ["prompt", "chosen"],
    ["instruction", "chosen", "rejected"],
    ["instruction", "chosen_response", "rejected_response"],
    ["instruction", "response_a", "response_b"],
    ["instruction", "output_1", "output_2"],
    ["instruction", "output"],
    ["query", "chosen", "rejected"],
    ["query", "chosen_response", "rejected_response"],
    ["question", "chosen", "rejected"],
    ["question", "positive", "negative"],
    ["question", "positive"],
    ["question", "answer"],
    ["input", "chosen", "rejected"],
    ["input", "chosen_response", "rejected_response"],
    ["input", "output_a", "output_b"],
    ["input", "response_a", "response_b"],
    ["input", "output"],
    ["input", "target"],
    ["system", "question", "chosen", "rejected"],
    ["system", "user", "chosen", "rejected"],
    ["system", "human", "chosen", "rejected"],
    ["system", "prompt", "chosen", "rejected"],
    ["text", "chosen", "rejected"],
    ["context", "chosen", "rejected"],
    ["context", "response_a", "response_b"],
    ["context", "answer_a", "answer_b"],
    ["conversations", "chosen", "rejected"],
    ["messages", "chosen", "rejected"],
    ["dialogue", "chosen", "rejected"],
    ["human", "assistant"],
    ["human", "chosen", "rejected"],
]


class ColumnError(ValueError):
    """A required column is missing or an explicit one does not exist."""


def resolve_headers(
    columns: Sequence[str], mapping: Mapping[str, str | None] | None = None
) -> dict[str, str]:
    """Role to column name: explicit names, then canonical names, then aliases."""
    by_lower = {c.lower(): c for c in columns}
    explicit = {r: name for r, name in (mapping or {}).items() if name is not None}
    for name in explicit.values():
        if not isinstance(name, str):
            raise ColumnError("column names must be strings")
        if name.lower() not in by_lower:
            raise ColumnError(f"column {name} not found")
    resolved = {r: by_lower[name.lower()] for r, name in explicit.items()}
    for role in ROLES:
        names = [n for n in [role, *ALIASES[role]] if n in by_lower]
        if role not in resolved and names:
            resolved[role] = by_lower[names[0]]
    for role in ROLES[:2]:
        if role not in resolved:
            raise ColumnError(f"missing column {role}")
    return resolved


def canonicalize(
    df: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project to the ordered roles; ``classification`` is T with negatives, else D."""
    resolved = resolve_headers(df.columns, mapping)
    roles = [r for r in ROLES if r in resolved]
    return df.select(
        *keep,
        *[F.col(f"`{resolved[r]}`").alias(r) for r in roles],
        F.lit("T" if "negative" in roles else "D").alias("classification"),
    )


def match_schema(df: DataFrame, columns: str = "columns") -> DataFrame:
    """Add the first allowed schema covered by an array of column names.

    The columns map to roles by position. Two-column schemas give duples; the
    fourth column of a wide schema is not used.
    """
    schemas = ALLOWED_SCHEMAS
    ordinal = F.lit(None).cast("int")
    for place, schema in reversed(list(enumerate(schemas))):
        covered = reduce(lambda a, b: a & b, [F.array_contains(columns, n) for n in schema])
        ordinal = F.when(covered, F.lit(place)).otherwise(ordinal)
    # One constant row per schema; a missing third column stays null.
    names = F.array(*[F.array(*[F.lit(n) for n in s[:3]]) for s in schemas])
    matched = df.withColumn("schema_ordinal", ordinal)
    chosen = F.get(names, F.col("schema_ordinal"))
    return matched.withColumns(
        {f"{role}_column": F.get(chosen, F.lit(k)) for k, role in enumerate(ROLES)}
    ).withColumn(
        "classification",
        F.when(F.col("negative_column").isNotNull(), "T").when(
            F.col("schema_ordinal").isNotNull(), "D"
        ),
    )


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def escape_formulas(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Escape formula starts in every string column (or the given ones)."""
    names = string_columns(df) if columns is None else list(columns)
    return df.withColumns({c: escape_formula(F.col(f"`{c}`")) for c in names})


def cell_violations(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per malformed cell with its rule and its first 50 characters."""
    names = columns or [c for c in string_columns(df) if c not in keys]
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("cell"))
                for c in names
            ]
        )
    )
    return (
        df.select(*keys, cells.alias("c"))
        .select(*keys, "c.column_name", "c.cell")
        .withColumn("violation", cell_violation(F.col("cell")))
        .filter(F.col("violation").isNotNull())
        .select(
            *keys,
            "column_name",
            "violation",
            F.substring("cell", 1, 50).alias("shown"),
        )
    )


# All Unicode white space, as a regex character list.
WHITE_SPACE = (
    r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)


def is_blank(cell: Column) -> Column:
    """True for text without a visible character."""
    return ~cell.cast("string").rlike(f"[^{WHITE_SPACE}]")


def valid_triplet(columns: Sequence[str] = ROLES) -> Column:
    """Every given column is present and not blank."""
    return reduce(
        lambda a, b: a & b,
        [F.col(c).isNotNull() & ~F.coalesce(is_blank(F.col(c)), F.lit(True)) for c in columns],
    )


def validation_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Null and blank counts of each role and the first error, in one pass."""
    counts = [F.count("*").alias("num_rows")]
    for role in ROLES:
        cell = F.col(role)
        counts.append(F.count_if(cell.isNull()).alias(f"null_{role}"))
        counts.append(
            F.count_if(F.coalesce(is_blank(cell), F.lit(False))).alias(f"blank_{role}")
        )
    counts.append(F.count_if(valid_triplet()).alias("valid_rows"))

    error = F.when(F.col("num_rows") == 0, F.lit("dataset is empty"))
    for kind, word in [("null", "null"), ("blank", "empty")]:
        for role in ROLES:
            n = F.col(f"{kind}_{role}")
            error = error.when(
                n > 0, F.format_string(f"Column '{role}' contains %d {word} values", n)
            )
    return df.groupBy(*by).agg(*counts).withColumn("error", error)


def missing_columns(columns: Sequence[str]) -> list[str]:
    """Required triplet columns that a stored dataset lacks; case matters here."""
    return [role for role in ROLES if role not in columns]


def training_errors(
    wanted: DataFrame, registry: DataFrame, reports: DataFrame, key: str = "id"
) -> DataFrame:
    """Why each wanted dataset can't be used for training; null when it can.

    ``registry`` has the key and an array ``columns`` of the stored file,
    ``reports`` a ``validation_report`` by key. All errors of a dataset come
    together, the first cause first: unknown, missing columns, bad values.
    """
    known = registry.select(key, "columns", F.lit(True).alias("__known"))
    found = wanted.select(key).distinct().join(known, key, "left")
    found = found.join(reports.select(key, F.col("error").alias("__bad"), F.lit(True).alias("__read")), key, "left")
    lacking = F.array_except(F.array(*map(F.lit, ROLES)), F.col("columns"))
    problems = F.array(
        F.when(F.col("__known").isNull(), F.lit("dataset not found")),
        F.when(F.size(lacking) > 0, F.concat(F.lit("missing columns: "), F.array_join(lacking, ", "))),
        F.when(F.col("__known") & F.col("__read").isNull(), F.lit("dataset is empty")),
        F.when(F.col("__known"), F.col("__bad")),
    )
    message = F.array_join(F.array_compact(problems), "; ")
    return found.select(key, F.when(message != "", message).alias("error"))


def require_valid(df: DataFrame) -> DataFrame:
    """The rows themselves, failing the job at the first invalid one."""
    problem = F.raise_error(F.lit("triplet with a null or blank value"))
    checked = F.when(valid_triplet(), F.col("question")).otherwise(problem.cast("string"))
    return df.withColumn("question", checked)


def schema_mapping(columns: Sequence[str]) -> dict[str, str]:
    """Role to column by the first allowed schema that ``columns`` cover."""
    present = set(columns)
    for names in ALLOWED_SCHEMAS:
        if present.issuperset(names):
            return dict(zip(ROLES, names))
    raise ColumnError(f"columns {sorted(present)} match no allowed schema")

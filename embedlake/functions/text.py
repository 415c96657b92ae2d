"""Text, naming and cell-check expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters in tie order and the default when none is found.
DELIMITERS = [",", ";", "\t", "|"]
DEFAULT_DELIMITER = ";"
DELIMITER_SAMPLE_CHARS = 1024

# Lower-case patterns that mark a file as malicious.
FORMULA_PATTERNS = ["=cmd", "=sum", "@", "=importxml"]
HEADER_BYTES = 1_048_576

# Dataset and media extensions, and the kinds training accepts.
DATASET_EXTENSIONS = ["csv", "json", "jsonl", "xml", "xlsx", "xls"]
MEDIA_EXTENSIONS = ["png", "jpg", "jpeg", "pdf"]
TRAINING_EXTENSIONS = ["csv", "tsv", "jsonl"]
MAX_NAME_LENGTH = 255
MAX_UPLOAD_BYTES = 53_687_091_200

UUID_PATTERN = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"

BYTE_UNITS = [("GB", 1024**3), ("MB", 1024**2), ("KB", 1024)]


def occurrences(text: Column, token: str) -> Column:
    """How often a one-byte token occurs; byte lengths need no decoding."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(token), F.lit("")))


def delimiter(text: Column, sample_chars: int | None = DELIMITER_SAMPLE_CHARS) -> Column:
    """Most frequent delimiter of the leading sample, first listed on ties."""
    sample = text if sample_chars is None else F.substring(text, 1, sample_chars)
    # Count and place in one number: each count is computed once.
    n = len(DELIMITERS)
    best = F.greatest(
        *[occurrences(sample, d) * n + (n - 1 - i) for i, d in enumerate(DELIMITERS)]
    )
    # Below n nothing was counted.
    choices = F.array(*map(F.lit, [DEFAULT_DELIMITER, *reversed(DELIMITERS)]))
    place = F.when(best >= n, best % n + 1).otherwise(F.lit(0))
    return F.coalesce(F.get(choices, place), F.lit(DEFAULT_DELIMITER))


def content_verdict(
    text: Column, extension: Column, header_bytes: int | None = HEADER_BYTES
) -> Column:
    """First failing content gate of a file, null when the file passes."""
    head = text if header_bytes is None else F.substring(text, 1, header_bytes)
    lowered = F.lower(head)
    suspicious = reduce(
        lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in FORMULA_PATTERNS]
    )
    is_workbook = extension == "xlsx"
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("empty_file"))
        .when(~extension.isin(DATASET_EXTENSIONS), F.lit("unsupported_format"))
        .when(~is_workbook & F.contains(head, F.lit("\x00")), F.lit("nul_byte"))
        .when(~is_workbook & suspicious, F.lit("malicious_content"))
    )


def escape_formula(cell: Column) -> Column:
    """Prefix ``'`` when the first visible character starts a formula."""
    return F.when(
        cell.rlike(r"^[\x00-\x20]*[=+\-@]"), F.concat(F.lit("'"), cell)
    ).otherwise(cell)


def cell_violation(cell: Column) -> Column:
    """First malformed-CSV rule a cell breaks, null for a clean cell."""
    wrapped = F.startswith(cell, F.lit('"')) & F.endswith(cell, F.lit('"'))
    return (
        F.when(occurrences(cell, '"') % 2 == 1, F.lit("unbalanced_quotes"))
        .when(F.contains(cell, F.lit('""')) & ~wrapped, F.lit("double_quotes"))
        .when(cell.rlike(r"[,;|\n\r]") & ~wrapped, F.lit("special_characters"))
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """Name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))


def sanitized_name(path: Column, allowed: list[str] = DATASET_EXTENSIONS) -> dict[str, Column]:
    """Safe file name, its extension and the reason a name is refused."""
    name = base_name(path)
    raw_stem, ext = stem(name), extension(name)
    safe = F.regexp_replace(raw_stem, r"[^A-Za-z0-9_-]", "_")
    error = (
        F.when((raw_stem == "") | (ext == ""), F.lit("filename_missing"))
        .when(~ext.isin(allowed), F.lit("unsupported_format"))
        .when(F.length(safe) > MAX_NAME_LENGTH, F.lit("filename_too_long"))
    )
    return {
        "file_name": F.when(error.isNull(), F.concat(safe, F.lit("."), ext)),
        "extension": ext,
        "name_error": error,
    }


def training_file_error(path: Column, length: Column) -> Column:
    """Why a stored file cannot be trained on, null when it can."""
    return (
        F.when(length.isNull(), F.lit("file_not_found"))
        .when(length == 0, F.lit("empty_file"))
        .when(~extension(base_name(path)).isin(TRAINING_EXTENSIONS), F.lit("unsupported_format"))
    )


def safe_model_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")


def normalized_model_tag(tag: Column) -> Column:
    """Folder form of a model tag; trained and local models stay as they are."""
    keeps = (
        F.startswith(tag, F.lit("trained_models/"))
        | F.startswith(tag, F.lit("models/"))
        | F.contains(tag, F.lit("finetuned"))
    )
    dashed = F.replace(tag, F.lit("_"), F.lit("--"))
    return (
        F.when(keeps, tag)
        .when(F.startswith(dashed, F.lit("models--")), dashed)
        .otherwise(F.concat(F.lit("models--"), dashed))
    )


def finetuned_name(tag: Column, started: Column, task_id: Column) -> Column:
    """Output name of a fine-tuned model."""
    short = F.replace(F.regexp_replace(tag, "^models--", ""), F.lit("--"), F.lit("-"))
    return F.concat(
        short,
        F.lit("-finetuned-"),
        F.date_format(started, "yyyyMMdd-HHmmss"),
        F.lit("-"),
        F.substring(task_id, 1, 8),
    )


def dataset_names(tag: Column, split: Column, subset: Column) -> dict[str, Column]:
    """Registry name and file name of one subset and split of a dataset."""
    named_subset = F.when(subset != "default", subset)
    safe_tag = F.replace(tag, F.lit("/"), F.lit("_"))
    return {
        "dataset_name": F.concat_ws("_", tag, split, named_subset),
        "file_name": F.concat(
            F.concat_ws("_", safe_tag, split, named_subset), F.lit(".jsonl")
        ),
    }


def readable_size(size: Column) -> Column:
    """Byte count as GB, MB or KB with two decimals, else plain bytes."""
    shown = F.lit(None).cast("string")
    for unit, width in reversed(BYTE_UNITS):
        # Half-even keeps exact ties as a binary-float formatter shows them.
        value = F.bround(size.cast("double") / F.lit(float(width)), 2)
        shown = F.when(size >= width, F.format_string(f"%.2f {unit}", value)).otherwise(
            shown
        )
    return F.coalesce(shown, F.concat(size.cast("string"), F.lit(" bytes")))


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID_PATTERN)


def expected_version(header: Column) -> Column:
    """Integer inside a quoted version header, null when it is malformed."""
    digits = F.regexp_extract(F.trim(header), r'^"+\s*([+-]?[0-9]+)\s*"+$', 1)
    return F.when(digits != "", digits.try_cast("int"))


# Task statuses by name.
STATUS_CODES = {"QUEUED": "Q", "RUNNING": "R", "DONE": "D", "FAILED": "F"}


def decoded_status(raw: Column) -> Column:
    """Status code from a code or a name in any case; anything else failed."""
    choice = F.when(raw.isin(list(STATUS_CODES.values())), raw)
    for name, code in STATUS_CODES.items():
        choice = choice.when(F.upper(raw) == name, F.lit(code))
    return choice.otherwise(F.lit("F"))


def tokens(text: Column) -> Column:
    """Whitespace tokens: a stand-in for a model's own tokenizer."""
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), 0)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+"))

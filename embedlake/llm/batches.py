"""Arrow batches of texts in bounded slices, and small column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold about `limit` bytes.

    A single longer text is a slice of its own; nothing is dropped or cut.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; a null text is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of the texts of a slice; a null text is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def take(docs: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Just the needed columns, so clashing extra columns never meet ours."""
    return docs.select(*names, *[F.col(old).alias(new) for new, old in renamed.items()])


def packed(docs: DataFrame) -> Column:
    """All columns in one, so that joins can add names of any kind beside them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def unpacked(rows: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The packed columns again; some may be replaced."""
    return rows.select(*[replaced.get(c, F.col("row").getField(c)).alias(c) for c in names])

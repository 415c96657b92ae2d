"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda total, x: total + x.cast("double") * x.cast("double"),
    )


def cosine(
    a: Column, b: Column, a_sq: Column | None = None, b_sq: Column | None = None
) -> Column:
    """Cosine similarity of two aligned vectors; a zero vector scores 0.

    Squared norms can be passed in when they were computed once per vector.
    """
    scale = F.sqrt((squared_norm(a) if a_sq is None else a_sq)) * F.sqrt(
        squared_norm(b) if b_sq is None else b_sq
    )
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def prefix(v: Column, dimensions: int | None) -> Column:
    """First ``dimensions`` values, not renormalised; all when there are fewer."""
    return v if dimensions is None else F.slice(v, 1, dimensions)

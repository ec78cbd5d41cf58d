"""Vector functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector is zero or holds NaN."""
    length = norm(a) * norm(b)
    value = dot(a, b) / F.when(length > 0, length)
    return F.when(~F.isnan(value), value)


def l2_normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def is_usable(a: Column, dim: int) -> Column:
    """Of the right length, no null or NaN element, not all zero."""
    ok = (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(a, lambda x: x != 0)
    return F.coalesce(a.isNotNull() & ok, F.lit(False))


def as_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))

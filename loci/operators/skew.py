"""Per-key results when a few keys hold most rows.

Rows are first compressed to value frequencies ``(key, value, n)``, so that a key with a third of
all rows is spread over as many groups as it has values and repeated values travel once. Distinct
counts, modes and percentiles then come from the weighted values. Percentiles need an order within
a key; it is made of order-preserving ranges of values, so no task ever holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges a value domain is cut into for cumulative counts; only balance depends on it, never results.
VALUE_RANGES = 64


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "value") -> DataFrame:
    """``(keys..., name, n)``: one row per key and value with the number of rows that hold it.

    Null keys and null values are kept as values of their own; callers drop what is no value to
    them. The group-by combines on the map side, so a hot key moves one row per task and value.
    """
    col = F.col(value) if isinstance(value, str) else value
    return df.select(*keys, col.alias(name)).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))


def _ranged(freq: DataFrame, value: str, ranges: int) -> DataFrame:
    """Add ``__range``, a bucket number that grows with ``value``; borders come from a sketch over all values."""
    cuts = freq.agg(
        F.percentile_approx(F.col(value), [i / ranges for i in range(1, ranges)], 1000).alias("cuts")
    )
    # A scalar subquery of fixed size (ranges - 1 numbers), whatever the data.
    return freq.withColumn("__cuts", cuts.scalar()).withColumn(
        "__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    ).drop("__cuts")


def cumulative(freq: DataFrame, keys: Sequence[str], value: str, ranges: int = VALUE_RANGES) -> DataFrame:
    """Add to value frequencies ``below`` (rows of the key with a smaller value) and ``total`` (rows of the key).

    ``freq`` holds each (keys, value) once with its count ``n``. The running sum is two-level: a
    window over the at most ``ranges`` range totals of a key, then one within a range.
    """
    part = _ranged(freq, value, ranges)
    sums = part.groupBy(*keys, "__range").agg(F.sum("n").alias("__in_range"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *keys,
        "__range",
        F.coalesce(F.sum("__in_range").over(before), F.lit(0)).alias("__before"),
        F.sum("__in_range").over(by_key).alias("total"),
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    left, right = part.alias("l"), sums.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l.__range") == F.col("r.__range")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = left.join(right, on).select("l.*", "r.__before", "r.total")
    return joined.withColumn("below", F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop(
        "__before", "__range"
    )


def key_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n_rows, n_distinct, mode, mode_rows)`` per key, exact, from value frequencies of ``value``.

    Null values count as rows but not as a distinct value or mode; ties for the mode go to the
    smallest value. A null key is a key of its own. An empty table gives no rows. Columns of ``df``
    other than the two named are ignored, whatever their names.
    """
    freq = value_frequencies(df.select(F.col(key).alias("__key"), F.col(value).alias("__value")), ["__key"], "__value")
    # max over (n, then smallest value): the mode in one combinable aggregate.
    best = F.when(F.col("value").isNotNull(), F.col("n"))
    first = freq.groupBy("__key").agg(
        F.sum("n").alias("n_rows"),
        F.count("value").alias("n_distinct"),
        F.max(best).alias("mode_rows"),
    )
    modes = (
        freq.where(F.col("value").isNotNull())
        .groupBy("__key", "n")
        .agg(F.min("value").alias("value"))
        .groupBy("__key")
        .agg(F.max_by("value", "n").alias("mode"))
    )
    return (
        first.alias("a")
        .join(modes.alias("b"), F.col("a.__key").eqNullSafe(F.col("b.__key")), "left")
        .select(F.col("a.__key").alias(key), "n_rows", "n_distinct", "mode", "mode_rows")
    )


def key_percentiles(df: DataFrame, key: str, value: str, shares: Sequence[float], ranges: int = VALUE_RANGES) -> DataFrame:
    """``(key, share, percentile)``: nearest-rank percentiles of a numeric ``value`` per key, exact.

    The percentile of share q over N values is the smallest value with at least ``ceil(q N)``
    values at or below it. Null and NaN values take no part; a key with none of the others has no
    row. A null key is a key of its own.
    """
    src = df.select(F.col(key).alias("__key"), F.col(value).cast("double").alias("value"))
    src = src.where(F.col("value").isNotNull() & ~F.isnan("value"))
    run = cumulative(value_frequencies(src, ["__key"], "value"), ["__key"], "value", ranges)
    want = F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share")
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total")))
    return (
        run.select("__key", "value", "n", "below", "total", want)
        .where((F.col("below") < rank) & (rank <= F.col("below") + F.col("n")))
        .select(F.col("__key").alias(key), "share", F.col("value").alias("percentile"))
    )


def heavy_values(df: DataFrame, key: str, within: str, min_share: float) -> DataFrame:
    """Values of ``key`` that hold at least ``min_share`` of all rows of ``df``: ``(key, n_rows)``.

    Rows without key count in the total but are no value. Counts come from the value frequencies
    of ``within`` (key and value first, then key), the same compression as the other results here.
    """
    freq = value_frequencies(df.select(F.col(key).alias("__key"), F.col(within).alias("__value")), ["__key"], "__value")
    per_key = freq.groupBy("__key").agg(F.sum("n").alias("n_rows"))
    total = per_key.agg(F.sum("n_rows").alias("__total"))
    return per_key.where(
        F.col("__key").isNotNull() & (F.col("n_rows") >= F.lit(min_share) * total.scalar())
    ).select(F.col("__key").alias(key), "n_rows")

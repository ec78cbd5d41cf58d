"""One ranking from scores on different scales, by leximin.

Each score becomes a percentile within its group; an item's own percentiles are sorted ascending
and items are compared by those arrays, the weakest score first, so that no single score can mask
a weak one and no scale counts. Percentiles come from two-level running counts over value
frequencies, so a group with a third of all rows, or one score that many items share, is no single
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loci.operators.skew import value_frequencies
from loci.runtime import stored


def _evidence(score: str) -> Column:
    c = F.col(score).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0), c)


#: Ranges of values per doubling; only balance depends on it, never results.
_PER_DOUBLING = 256


def _range(value: Column) -> Column:
    """A number that grows with the value, the same for all groups, so that borders cost no pass over the data."""
    return F.when(value > 0, F.floor(F.log2(value) * _PER_DOUBLING)).otherwise(F.when(value == 0, F.lit(-(2**40))).otherwise(F.lit(-(2**41)))).cast("bigint")


def leximin_scores(df: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    """``(group, item, weakest_first)``: each item once, with its percentiles in ascending order.

    A percentile is the share of the group's other items whose score is lower, so a score that many
    share ranks no higher than the lowest place of theirs; null, NaN and negative scores are no
    evidence, below all others, and get 0. Rows repeated under one (group, item) count once, each
    score by its highest evidence. Rows with null group or item take no part. Other columns are
    ignored.
    """
    named = df.select(F.col(group).alias("__g"), F.col(item).alias("__i"), *[_evidence(s).alias(f"__s{k}") for k, s in enumerate(scores)])
    named = named.where(F.col("__g").isNotNull() & F.col("__i").isNotNull())
    cols = [f"__s{k}" for k in range(len(scores))]
    # Read twice, for the frequencies and for the items.
    one = stored(named.groupBy("__g", "__i").agg(*[F.max(c).alias(c) for c in cols]), "items")
    long = one.select("__g", "__i", F.posexplode(F.array(*[F.coalesce(c, F.lit(-1.0)) for c in cols])).alias("k", "value"))
    freq = value_frequencies(long, ["__g", "k"], "value").withColumn("r", _range(F.col("value")))
    inside = Window.partitionBy("__g", "k", "r").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(freq.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))), "places")
    sums = placed.groupBy("__g", "k", "r").agg(F.sum("n").alias("m"))
    all_of = Window.partitionBy("__g", "k")
    before = F.coalesce(F.sum("m").over(all_of.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__g", "k", "r", before.alias("before"), F.sum("m").over(all_of).alias("total"))
    share = (F.col("before") + F.col("inner")) / F.greatest(F.col("total") - 1, F.lit(1))
    shares = placed.where("value >= 0").join(sums, ["__g", "k", "r"]).select("__g", "k", "value", share.alias("share"))
    known = long.where("value >= 0").join(shares, ["__g", "k", "value"]).select("__g", "__i", "share")
    every = known.unionByName(long.where("value < 0").select("__g", "__i", F.lit(0.0).alias("share")))
    return (
        every.groupBy("__g", "__i")
        .agg(F.sort_array(F.collect_list("share")).alias("weakest_first"))  # as many entries as scores
        .select(F.col("__g").alias(group), F.col("__i").alias(item), "weakest_first")
    )


def leximin_first(df: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    """``(group, item)``: the first of each group; ties go to the smallest item."""
    ranked = leximin_scores(df, group, item, scores)
    # The least of the negated arrays, then of the items: one aggregate that combines before the shuffle.
    best = F.min(F.struct(F.transform("weakest_first", lambda x: -x).alias("a"), F.col(item).alias("i")))
    return ranked.groupBy(group).agg(best.alias("__best")).select(group, F.col("__best.i").alias(item))


def leximin_ranks(df: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    """``(group, item, weakest_first, rank)``: rank 1 is best; equal arrays share the rank of the first.

    Ranks are running counts over distinct arrays, in order-preserving ranges of the arrays' first
    entries above 0, so a hot group is split by range.
    """
    # Read twice, for the order of the arrays and for the items.
    ranked = stored(leximin_scores(df, group, item, scores).withColumnsRenamed({group: "__g", item: "__i"}), "ranked")
    freq = value_frequencies(ranked, ["__g"], "weakest_first", "arr")
    # More entries of 0 come last; among as many, the first entry above 0 decides before all others.
    grid = 1000.0
    zeros = F.size(F.filter("arr", lambda x: x == 0))
    first = F.coalesce(F.try_element_at("arr", zeros + 1), F.lit(0.0))
    freq = freq.withColumn("range", ((F.size("arr") - zeros) * (grid + 1) + F.floor(first * grid)).cast("long"))
    per = freq.groupBy("__g", "range").agg(F.sum("n").alias("m"))
    better = Window.partitionBy("__g").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("above", F.coalesce(F.sum("m").over(better), F.lit(0))).drop("m")
    inside = Window.partitionBy("__g", "range").orderBy(F.col("arr").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = freq.join(per, ["__g", "range"]).select(
        "__g", "arr", (F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + 1).alias("rank")
    )
    return ranked.join(ranks.withColumnRenamed("arr", "weakest_first"), ["__g", "weakest_first"]).select(
        F.col("__g").alias(group), F.col("__i").alias(item), "weakest_first", F.col("rank").cast("long").alias("rank")
    )

"""Exact ranks and order statistics that do not pull a hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups with more distinct values than this are cut into value ranges first.
SPLIT_ABOVE = 1_000_000
_CUTS = 255


def cumulative_counts(df: DataFrame, keys: list[str], value: str, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """One row per (keys, value): ``cnt`` copies, ``upto`` = copies at or below, ``n`` = group size.

    Copies are counted on the map side. Groups above ``split_above`` distinct values are cut at
    approximate quantiles; each range is ranked alone and shifted by the exact size of those below.
    """
    if not keys:
        return cumulative_counts(df.withColumn("_all", F.lit(0)), ["_all"], value, split_above).drop("_all")
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    sizes = hist.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("_distinct"))
    hot = sizes.filter(F.col("_distinct") > split_above).select(*keys)
    probs = [i / (_CUTS + 1) for i in range(1, _CUTS + 1)]
    cuts = hist.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(value, probs, 10000).alias("_cuts"))
    ranged = (
        hist.join(sizes.select(*keys, "n"), keys)
        .join(cuts, keys, "left")
        .withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0)))
        .withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_range")))
        .drop("_cuts")
    )
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("cnt").alias("_total"))
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, "_range", F.coalesce(F.sum("_total").over(below), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(shifts, [*keys, "_range"]).select(
        *keys, value, "cnt", "n", (F.col("_shift") + F.sum("cnt").over(within)).alias("upto")
    )


def ci_indices(n: Column, cf: float) -> tuple[Column, Column]:
    """0-based order statistics of a ``cf`` % interval, no interpolation, clamped to the sample."""
    tail = (100.0 - cf) / 2.0
    low = F.floor(n / 100.0 * F.lit(tail))
    high = F.least(F.floor(n - n / 100.0 * F.lit(tail)), n - 1)
    return low, high


def credible_interval(df: DataFrame, keys: list[str], value: str, cf: float = 95.0, **kw) -> DataFrame:
    """keys, ci_low, ci_high."""
    ranked = cumulative_counts(df, keys, value, **kw)
    low, high = ci_indices(F.col("n"), cf)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("cnt") <= index) & (index < F.col("upto")), F.col(value)))

    return ranked.groupBy(*keys).agg(at(low).alias("ci_low"), at(high).alias("ci_high"))

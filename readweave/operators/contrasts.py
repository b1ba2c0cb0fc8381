"""Comparing two conditions: positive log ratio probability, fold changes, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.functions.numeric import safe_log
from readweave.functions.order import credible_interval

LN2 = math.log(2.0)


def paired_draws(samples: DataFrame, first: int = 0, second: int = 1, logged: bool = False, zero: str = "error") -> DataFrame:
    """(tr, n, a, b) log values of two files, one pass over the samples."""
    x = samples.filter(F.col("file_idx").isin(first, second))
    value = F.col("value") if logged else safe_log(F.col("value"), zero)

    def of(file: int) -> Column:
        return F.sum(F.when(F.col("file_idx") == file, value))

    return x.groupBy("tr", "n").agg(of(first).alias("a"), of(second).alias("b")).filter("a is not null and b is not null")


def log_ratio_distribution(samples: DataFrame, select: DataFrame | None = None, **kw) -> DataFrame:
    """tr, n, log2 ratio second/first, for all or the selected transcripts."""
    if select is not None:
        samples = samples.join(select.select("tr").distinct(), "tr", "left_semi")
    p = paired_draws(samples, **kw)
    return p.select("tr", "n", ((F.col("b") - F.col("a")) / LN2).alias("log_ratio"))


def pplr(samples: DataFrame, cf: float = 95.0, **kw) -> DataFrame:
    """tr, pplr, log2fc, ci_low, ci_high, mean_a, mean_b of files ``first`` and ``second``.

    Equal draws do not count as positive.
    """
    p = paired_draws(samples, **kw).withColumn("d", (F.col("b") - F.col("a")) / LN2)
    stats = p.groupBy("tr").agg(
        F.avg((F.col("b") > F.col("a")).cast("double")).alias("pplr"),
        F.avg("d").alias("log2fc"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
    )
    ci = credible_interval(p, ["tr"], "d", cf)
    return stats.join(ci, "tr").select("tr", "pplr", "log2fc", "ci_low", "ci_high", "mean_a", "mean_b")


def fold_change(samples: DataFrame, logged: bool = False, zero: str = "ieee") -> DataFrame:
    """tr, n, log2 fold change between condition 1 and 0; replicates enter as the mean of their logs.

    Input carries ``cond`` and ``rep``; draws that lack a condition are left out.
    """
    value = F.col("value") if logged else safe_log(F.col("value"), zero)

    def mean_of(c: int) -> Column:
        return F.avg(F.when(F.col("cond") == c, value))

    g = samples.groupBy("tr", "n").agg(mean_of(0).alias("a"), mean_of(1).alias("b"))
    return g.filter("a is not null and b is not null").select("tr", "n", ((F.col("b") - F.col("a")) / LN2).alias("log2fc"))

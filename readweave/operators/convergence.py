"""Chain diagnostics, thinning and abundance means on draws (chain, tr, n, theta)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.functions.numeric import safe_log
from readweave.functions.order import cumulative_counts


def chain_moments(draws: DataFrame) -> DataFrame:
    """Per (tr, chain): draws, mean and sample variance of theta and of its logit."""
    t = F.col("theta")
    x = draws.withColumn("_l", safe_log(t, "ieee") - safe_log(1 - t, "ieee"))
    return x.groupBy("tr", "chain").agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg("theta").alias("mean"), F.var_samp("theta").alias("var"),
        F.avg("_l").alias("mean_logit"), F.var_samp("_l").alias("var_logit"),
    )


def moments_from_sums(state: DataFrame) -> DataFrame:
    """The same from running sums s1, s2, l1, l2 over ``draws`` iterations."""
    n = F.col("draws")

    def var(s2: str, s1: str):
        return F.try_divide(F.col(s2) - F.col(s1) * F.col(s1) / n, n - 1)

    return state.select(
        "tr", "chain", "draws",
        (F.col("s1") / n).alias("mean"), var("s2", "s1").alias("var"), (F.col("l1") / n).alias("mean_logit"), var("l2", "l1").alias("var_logit"),
    )


def rhat(moments: DataFrame) -> DataFrame:
    """tr, rhat (logit scale), rhat_theta, mean_theta, within_logit, between_logit, draws."""
    g = moments.groupBy("tr").agg(
        F.avg("draws").alias("draws"),
        F.avg("mean").alias("mean_theta"),
        F.avg("var").alias("_w"), F.var_samp("mean").alias("_b"),
        F.avg("var_logit").alias("within_logit"), F.var_samp("mean_logit").alias("between_logit"),
    )
    n = F.col("draws")

    def ratio(b: str, w: str):
        value = F.sqrt((n - 1) / n + F.try_divide(F.col(b), F.col(w)))
        return F.when(F.coalesce("_w", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(value)

    return g.select(
        "tr", ratio("between_logit", "within_logit").alias("rhat"), ratio("_b", "_w").alias("rhat_theta"),
        "mean_theta", "within_logit", "between_logit", "draws",
    )


def rhat_worst(r: DataFrame, k: int = 10) -> DataFrame:
    """The k transcripts with the highest Rhat (top-k report)."""
    return r.orderBy(F.desc("rhat"), "tr").limit(k)


def rhat_unconverged(r: DataFrame, target: float = 1.2) -> DataFrame:
    return r.filter(F.col("rhat") > target)


def needed_samples(r: DataFrame, samples_save: int) -> DataFrame:
    """tr, needed: draws per chain for ``samples_save`` effective ones (logit scale)."""
    n = F.col("draws")
    ratio = F.try_divide(F.col("within_logit"), F.col("between_logit"))
    return r.filter(ratio.isNotNull()).select("tr", (samples_save * n / ((n - 1) / n * ratio + 1.0)).alias("needed"))


def effective_samples(r: DataFrame, samples_save: int) -> DataFrame:
    """m, needed_95, next_samples: the need that covers 95 % of the transcripts, index clamped."""
    ranked = cumulative_counts(needed_samples(r, samples_save), [], "needed")
    index = F.least(F.floor((F.col("n") + 1) * 0.95), F.col("n") - 1)
    at = F.max(F.when((F.col("upto") - F.col("cnt") <= index) & (index < F.col("upto")), F.col("needed")))
    return ranked.agg(F.max("n").alias("m"), at.alias("needed_95")).withColumn(
        "next_samples", F.greatest(F.floor("needed_95"), F.lit(samples_save).cast("long"))
    )


def theta_means(draws: DataFrame, n_reads: int) -> DataFrame:
    """tr, mean_theta, mean_count, mean_logit_theta, var_theta, chain_means."""
    m = chain_moments(draws)
    overall = draws.groupBy("tr").agg(F.avg("theta").alias("mean_theta"), F.var_samp("theta").alias("var_theta"))
    chains = m.groupBy("tr").agg(
        F.avg("mean_logit").alias("mean_logit_theta"),
        F.transform(F.array_sort(F.collect_list(F.struct("chain", "mean"))), lambda s: s["mean"]).alias("chain_means"),
    )
    return overall.join(chains, "tr").select(
        "tr", "mean_theta", F.floor(F.col("mean_theta") * n_reads + 0.5).cast("long").alias("mean_count"), "mean_logit_theta", "var_theta", "chain_means"
    )


def saved_after(i, total: int, out: int):
    """How many of the first ``i`` iterations are kept: even spacing, topped up at the tail."""
    rate = out / total
    spaced = F.floor(i * rate)
    tail = F.lit(out - total) + i + 1
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(out).cast("long"), i.cast("long"), F.greatest(spaced, tail.cast("long"))))


def thinning(iterations: DataFrame, total: int, out: int, i: str = "i") -> DataFrame:
    """Rows of the kept iterations (1-based ``i``); exactly ``out`` of ``total``."""
    x = F.col(i)
    return iterations.filter(saved_after(x, total, out) > F.when(x > 1, saved_after(x - 1, total, out)).otherwise(0))


def kept_iterations(total: int, out: int) -> set[int]:
    """The same rule for a driver loop: iterations after which one more is kept."""
    i = np.arange(total + 1)
    saved = np.clip(np.maximum(np.floor(out / total * i), out - total + i + 1), 0, np.minimum(i, out))
    return set((np.flatnonzero(np.diff(saved) > 0) + 1).tolist())

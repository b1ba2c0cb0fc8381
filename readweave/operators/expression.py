"""Differential expression with replicates: priors, posteriors, draws, reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readweave.functions import random as rnd
from readweave.functions.numeric import safe_log
from readweave.functions.order import credible_interval

LN2 = math.log(2.0)


def nearest_params(queries: DataFrame, params: DataFrame, expr: str = "expr") -> DataFrame:
    """Add alpha, beta of the nearest curve point to every row; ties go to the higher point.

    The curve's gaps become half-open intervals spread over a value grid, so the lookup is an
    equi-join on the grid cell plus a range test. Nothing is broadcast by decree. Of points
    that share an expression the last one (by alpha, beta) answers.
    """
    points = params.groupBy("expr").agg(F.max(F.struct("alpha", "beta")).alias("p")).select("expr", "p")
    dims = points.agg(F.min("expr").alias("_lo"), F.max("expr").alias("_hi"), F.count(F.lit(1)).alias("_k"))
    span = F.col("_hi") - F.col("_lo")
    dims = dims.withColumn("_w", F.when(span > 0, span / F.col("_k")).otherwise(F.lit(1.0)))
    # Window over the curve only: a point per sampled group of transcripts.
    follow = Window.orderBy("expr")
    gaps = points.select(
        F.col("expr").alias("_a"), F.col("p").alias("_pa"), F.lead("expr").over(follow).alias("_b"), F.lead("p").over(follow).alias("_pb")
    )
    first = points.groupBy().agg(F.min(F.struct("expr", "p")).alias("f")).select(
        F.lit(None).cast("double").alias("_a"), F.col("f.p").alias("_pa"), F.col("f.expr").alias("_b"), F.col("f.p").alias("_pb")
    )

    def cell(x):
        raw = F.floor((x - F.col("_lo")) / F.col("_w"))
        return F.greatest(F.lit(0).cast("long"), F.least(raw, F.col("_k") - 1))

    spread = gaps.unionByName(first).join(F.broadcast(dims))  # one row
    spread = spread.withColumn("_from", F.when(F.col("_a").isNull(), 0).otherwise(cell(F.col("_a"))))
    spread = spread.withColumn("_to", F.when(F.col("_b").isNull(), F.col("_k") - 1).otherwise(cell(F.col("_b"))))
    spread = spread.withColumn("_cell", F.explode(F.sequence(F.col("_from").cast("long"), F.col("_to").cast("long"))))
    spread = spread.select("_cell", "_a", "_pa", "_b", "_pb")
    located = queries.join(F.broadcast(dims)).withColumn("_cell", cell(F.col(expr))).drop("_lo", "_hi", "_k", "_w")  # one row
    q = F.col(expr)
    hit = located.join(
        spread,
        (located["_cell"] == spread["_cell"])
        & (spread["_a"].isNull() | (q >= spread["_a"]))
        & (spread["_b"].isNull() | (q < spread["_b"])),
    )
    lower = F.col("_b").isNull() | (q - F.col("_a") < F.col("_b") - q)
    pick = F.when(F.col("_a").isNull(), F.col("_pb")).when(lower, F.col("_pa")).otherwise(F.col("_pb"))
    return hit.select(*[queries[c] for c in queries.columns], pick["alpha"].alias("alpha"), pick["beta"].alias("beta"))


def log_samples(samples: DataFrame, logged: bool = False) -> DataFrame:
    return samples if logged else samples.withColumn("value", safe_log(F.col("value"), "eq0"))


def de_prior(samples: DataFrame, params: DataFrame, logged: bool = False) -> DataFrame:
    """tr, cond, mu_c, mu00, alpha, beta.

    mu_c is the mean log value over a condition's replicates and draws, mu00 the mean of mu_c.
    """
    x = log_samples(samples, logged)
    cond = x.groupBy("tr", "cond").agg(F.avg("value").alias("mu_c"))
    joint = cond.groupBy("tr").agg(F.avg("mu_c").alias("mu00"))
    return nearest_params(cond.join(joint, "tr"), params, "mu_c")


def de_posterior(samples: DataFrame, prior: DataFrame, lambda0: float = 2.0, logged: bool = False) -> DataFrame:
    """tr, cond, n, post_mean, post_alpha, post_beta, reps: normal-gamma update per draw."""
    x = log_samples(samples, logged)
    sums = x.groupBy("tr", "cond", "n").agg(
        F.count(F.lit(1)).alias("reps"), F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_ss")
    )
    j = sums.join(prior.select("tr", "cond", "mu00", "alpha", "beta"), ["tr", "cond"])
    centre = lambda0 * F.col("mu00")
    total = centre + F.col("_s")
    weight = lambda0 + F.col("reps")
    spread = centre * F.col("mu00") + F.col("_ss") - total * total / weight
    return j.select(
        "tr", "cond", "n",
        (total / weight).alias("post_mean"),
        (F.col("alpha") + F.col("reps") / 2.0).alias("post_alpha"),
        (F.col("beta") + spread / 2.0).alias("post_beta"),
        "reps",
    )


def de_samples(posterior: DataFrame, seed: int, lambda0: float = 2.0) -> DataFrame:
    """tr, cond, n, value, var: one draw of the condition mean per input draw."""
    drawn = rnd.with_gamma(posterior, "_prec", seed, F.col("post_alpha"), "tr", "cond", "n").withColumn("_prec", F.col("_prec") / F.col("post_beta"))
    drawn = drawn.withColumn("var", 1.0 / (F.col("_prec") * (lambda0 + F.col("reps"))))
    value = F.col("post_mean") + F.sqrt("var") * rnd.portable_normal(seed + 1, "tr", "cond", "n")
    return drawn.select("tr", "cond", "n", value.alias("value"), "var")


def condition_pairs(draws: DataFrame) -> DataFrame:
    """tr, n, cond_a, cond_b, d = value_b - value_a for every pair of conditions a < b."""
    a = draws.select("tr", "n", F.col("cond").alias("cond_a"), F.col("value").alias("_a"))
    b = draws.select("tr", "n", F.col("cond").alias("cond_b"), F.col("value").alias("_b"))
    return a.join(b, ["tr", "n"]).filter("cond_a < cond_b").select("tr", "n", "cond_a", "cond_b", (F.col("_b") - F.col("_a")).alias("d"))


def de_pplr(draws: DataFrame) -> DataFrame:
    """tr, cond_a, cond_b, pplr."""
    return condition_pairs(draws).groupBy("tr", "cond_a", "cond_b").agg(F.avg((F.col("d") > 0).cast("double")).alias("pplr"))


def de_fold_change(draws: DataFrame, cf: float = 95.0) -> DataFrame:
    """tr, cond_a, cond_b, log2fc, ci_low, ci_high."""
    keys = ["tr", "cond_a", "cond_b"]
    p = condition_pairs(draws).withColumn("d", F.col("d") / LN2)
    return p.groupBy(*keys).agg(F.avg("d").alias("log2fc")).join(credible_interval(p, keys, "d", cf), keys)


def de_means(draws: DataFrame) -> DataFrame:
    """tr, cond, mean of the drawn (log) condition means."""
    return draws.groupBy("tr", "cond").agg(F.avg("value").alias("mean"))


def last_variance(draws: DataFrame) -> DataFrame:
    """tr, n, var of the last condition, the only one the variance export holds."""
    last = draws.groupBy().agg(F.max("cond").alias("cond"))
    return draws.join(F.broadcast(last), "cond").select("tr", "n", "var")  # one row

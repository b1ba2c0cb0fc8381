"""Hyperparameters of the expression-dependent variance prior."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.functions import random as rnd
from readweave.functions.numeric import safe_log
from readweave.functions.ranking import global_rank, running_max
from readweave.operators.smoothing import smooth_params
from readweave.session import cut_lineage, discard

# Fixed values
GROUP_MIN, GROUP_MAX = 10, 5000
ALPHA_STEP, BETA_STEP = 0.1, 0.08
START = (10.0, 5.0)
FIRST_WIDTH, WIDTH_STEP = 4.0, 1.02
LOW_RATE, HIGH_RATE = 0.25, 0.5
MAX_PARAM = 5000.0
RETRIES = 10


def hyper_groups(means: DataFrame, groups: int = 200, ex_t: float = -5.0) -> DataFrame:
    """tr, mean, grp: transcripts in falling expression, cut into groups of similar expression.

    A group closes once it has 10 members and spans one expression step below the end of the group before, or
    at 5000; a rest below 10 is dropped. So the next group's first rank is a function of this one's. It is found for
    every rank, as if a group began there, and the ranks where groups do begin are reached from the first one by
    pointer doubling: each round composes the function with itself and doubles the number of known beginnings.
    """
    ranked = cut_lineage(global_rank(means.filter(F.col("mean").isNotNull()).select("tr", "mean"), "mean", "tr", "rank", descending=True))
    dims = ranked.agg(F.max("mean").alias("hi"), F.min("mean").alias("lo"), F.count_if(F.col("mean") >= ex_t).alias("n")).first()
    total = dims["n"]
    if not total:
        raise ValueError("no transcript above the expression threshold")
    kept = ranked.filter(F.col("mean") >= ex_t)
    # a group that begins behind rank r - 1 spans a step from the first value below that one less the step
    step = (dims["hi"] - dims["lo"]) / groups
    first = kept.filter("rank = 0").select(F.lit(0).cast("long").alias("rank"), F.lit(float(dims["hi"])).alias("end"))
    ends = kept.select((F.col("rank") + 1).alias("rank"), F.col("mean").alias("end")).filter(F.col("rank") < total).unionByName(first)
    limits = ends.select((F.col("rank") + total).alias("tie"), (F.col("end") - step).alias("x"))
    both = global_rank(kept.select(F.col("rank").alias("tie"), F.col("mean").alias("x")).unionByName(limits), "x", "tie", "place", descending=True)
    below = both.filter(F.col("tie") >= total).withColumn("rank", F.col("tie") - total)
    # limits fall with their ranks, so as many of them come before one as its rank says
    closes = F.least(F.greatest(F.col("place") - F.col("rank"), F.col("rank") + GROUP_MIN - 1), F.col("rank") + GROUP_MAX - 1)
    jumps = cut_lineage(below.select(F.col("rank").cast("long").alias("rank"), F.least(closes + 1, F.lit(total)).cast("long").alias("to")))
    begun = cut_lineage(kept.filter("rank = 0").select(F.lit(0).cast("long").alias("rank")))
    known, found = 0, 1
    while found > known:  # as many rounds as the number of groups has digits in base 2
        ahead = begun.join(jumps, "rank").select(F.col("to").alias("rank")).filter(F.col("rank") < total)
        more = cut_lineage(begun.unionByName(ahead).distinct())
        onward = jumps.select("rank", F.col("to").alias("_via")).join(jumps.select(F.col("rank").alias("_via"), "to"), "_via", "left")
        composed = cut_lineage(onward.select("rank", F.coalesce("to", F.lit(total)).alias("to")))
        discard(begun, jumps)
        begun, jumps = more, composed
        known, found = found, begun.count()
    discard(jumps)
    numbered = global_rank(begun, "rank", "rank", "grp").select(F.col("rank").cast("long").alias("rank"), F.col("grp").cast("long").alias("begins"))
    marked = kept.withColumn("rank", F.col("rank").cast("long")).join(numbered, "rank", "left")
    done = running_max(marked, "rank", "begins", "grp").select("tr", "mean", "grp")
    small = done.groupBy("grp").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= GROUP_MIN)
    return done.join(small, "grp", "left_semi").select("tr", "mean", "grp")


def hyper_badd(samples: DataFrame, means: DataFrame, lambda0: float = 2.0, logged: bool = False) -> DataFrame:
    """tr, cond, n, badd, reps: half the squared spread around the prior mean."""
    x = samples if logged else samples.withColumn("value", safe_log(F.col("value"), "eq0"))
    sums = x.groupBy("tr", "cond", "n").agg(
        F.count(F.lit(1)).alias("reps"), F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_ss")
    )
    j = sums.join(means.select("tr", F.col("mean").alias("_mu")), "tr")
    total = F.col("_s") + F.col("_mu") * lambda0
    badd = 0.5 * (F.col("_ss") + F.col("_mu") * F.col("_mu") * lambda0 - total * total / (lambda0 + F.col("reps")))
    return j.select("tr", "cond", "n", badd.alias("badd"), "reps")


def reps_table(reps: np.ndarray) -> list[tuple[float, int]]:
    """(half the replicates, cells) of a group."""
    sizes, counts = np.unique(reps / 2.0, return_counts=True)
    return [(float(h), int(c)) for h, c in zip(sizes, counts)]


def log_posterior(alpha: float, beta: float, badd: np.ndarray, half: np.ndarray, table: list[tuple[float, int]]) -> float:
    """Log likelihood of all (transcript, condition) cells of a group, up to a constant."""
    gammas = sum(c * (math.lgamma(alpha + h) - math.lgamma(alpha)) for h, c in table)
    return badd.size * alpha * math.log(beta) + gammas - float(((alpha + half) * np.log(beta + badd)).sum())


class Chain:
    """A reflected normal walk over (alpha, beta) of one group."""

    def __init__(self, rng, badd: np.ndarray, reps: np.ndarray) -> None:
        self.rng, self.badd, self.half, self.table = rng, badd, reps / 2.0, reps_table(reps)
        self.at = rng.uniform(size=2) * START
        self.density = self._density(self.at)

    def _density(self, at: np.ndarray) -> float:
        return log_posterior(*at.tolist(), self.badd, self.half, self.table) if (at > 0).all() else -math.inf

    def walk(self, steps: int, width: float) -> float:
        """Share of accepted steps; all proposals of the walk are drawn at once."""
        moves = self.rng.normal(size=(steps, 2)) * np.array([ALPHA_STEP, BETA_STEP]) * width
        dares = np.log(self.rng.uniform(size=steps))
        accepted = 0
        for move, dare in zip(moves, dares, strict=True):
            there = np.abs(self.at + move)
            density = self._density(there)
            if dare < density - self.density:
                self.at, self.density, accepted = there, density, accepted + 1
        return accepted / steps


def metropolis(rng, badd, reps, batch: int = 1000, max_batches: int = 1000):
    """One (alpha, beta) draw, or None when the walk does not settle.

    Batches narrow or widen their steps until one of them accepts a quarter to a half of its
    steps; the walk has settled once the step width was right for two batches in a row."""
    chain, width, rate, settled = Chain(rng, badd, reps), FIRST_WIDTH, 0.0, False
    for _ in range(max_batches):
        factor = 1 / WIDTH_STEP if rate < LOW_RATE else WIDTH_STEP if rate > HIGH_RATE else 1.0
        if factor == 1.0 and settled:
            return tuple(chain.at.tolist())
        if (chain.at > MAX_PARAM).any():
            return None
        width, settled = width * factor, factor == 1.0
        rate = chain.walk(batch, width)
    return None


def hyper_sample(
    badd: DataFrame, groups: DataFrame, samples_n: int = 2, seed: int = 0, batch: int = 1000, max_batches: int = 1000
) -> DataFrame:
    """expr, alpha, beta: one point per group and used draw; expr is the mean over the group's transcripts.

    Groups are independent seeded chains of at most 5000 transcripts. Draws are taken at random from
    the whole series, the same for all groups; one that does not settle is replaced by a further one,
    up to ten. Only the draws that can be used travel.
    """
    order = rnd.portable_uniform(seed, "n")
    drawn = badd.select("n").distinct().withColumn("try", order).orderBy("try", "n").limit(samples_n + RETRIES)
    expr = groups.groupBy("grp").agg(F.avg("mean").alias("expr"))
    members = groups.select("tr", "grp").join(expr, "grp")
    cells = badd.join(F.broadcast(drawn), "n").join(members, "tr").select("grp", "expr", "try", "n", "badd", "reps")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp, points = int(pdf["grp"].iloc[0]), []
        for (_, n), part in pdf.groupby(["try", "n"]):
            if len(points) < samples_n:
                part = part.sort_values(["badd", "reps"])
                rng = np.random.default_rng(np.random.SeedSequence([seed, grp, int(n)]))
                found = metropolis(rng, np.maximum(part["badd"].to_numpy(), 0.0), part["reps"].to_numpy(float), batch, max_batches)
                points += [(float(pdf["expr"].iloc[0]), *found)] if found else []
        return pd.DataFrame(points, columns=["expr", "alpha", "beta"])

    return cells.groupBy("grp").applyInPandas(lambda p: run(p), "expr double, alpha double, beta double")


def hyperparams(
    samples: DataFrame, means: DataFrame, groups: int = 200, samples_n: int = 2, lambda0: float = 2.0, ex_t: float = -5.0,
    f: float = 0.2, steps: int = 5, force: bool = True, logged: bool = False, seed: int = 0, **mh
) -> DataFrame:
    """The smoothed curve from samples (tr, cond, rep, n, value) and joint log means (tr, mean)."""
    grouped = hyper_groups(means, groups, ex_t)
    raw = hyper_sample(hyper_badd(samples, means, lambda0, logged), grouped, samples_n, seed, **mh)
    return smooth_params(cut_lineage(raw), f, steps, force)

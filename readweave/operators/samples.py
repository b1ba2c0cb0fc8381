"""Posterior-sample operators on the long form (file_idx, tr, n, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readweave.functions import random as rnd
from readweave.functions.numeric import safe_log


def convert(samples: DataFrame, action: str, tr: DataFrame | None = None, nmap: float | None = None) -> DataFrame:
    """Unit conversion: C2R R2C T2R R2T T2RL NORM LOGNORM.

    ``tr`` (tid, eff_length) is needed by the length-aware ones and must cover every transcript.
    """
    if action in ("C2R", "R2C", "NORM", "LOGNORM") and nmap is None:
        raise ValueError(f"{action} needs nmap")
    scale = 1.0 if nmap is None else float(nmap)
    x = F.col("value")
    if action in ("NORM", "LOGNORM"):
        value = x * scale if action == "NORM" else safe_log(x, "ieee") + math.log(scale)
        return samples.withColumn("value", value)
    if tr is None:
        raise ValueError(f"{action} needs transcript lengths")
    length = F.col("_eff")
    formulas: dict[str, Column] = {
        "C2R": x / (1e-9 * scale) / length,
        "R2C": x * 1e-9 * scale * length,
        "T2RL": safe_log(x / length, "ieee") + math.log(1e9 * scale),
    }
    formulas["T2R"], formulas["R2T"] = formulas["C2R"], formulas["R2C"]
    if action not in formulas:
        raise ValueError(f"unknown action {action}")
    lengths = tr.select(F.col("tid").alias("tr"), F.col("eff_length").alias("_eff"))
    return samples.join(lengths, "tr").withColumn("value", formulas[action]).drop("_eff").select(samples.columns)


def apply_norm(samples: DataFrame, constants: list[float]) -> DataFrame:
    """Multiply each file by its constant (logged values too, as given)."""
    value = F.element_at(F.array(*[F.lit(float(c)) for c in constants]), (F.col("file_idx") + 1).cast("int"))
    return samples.withColumn("value", F.col("value") * value)


def merge_files(samples: DataFrame) -> DataFrame:
    """Concatenate the draws of all files: n runs on across files (tr, n, value, file_idx)."""
    sizes = samples.groupBy("file_idx").agg((F.max("n") + 1).alias("_n"))
    before = Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = sizes.select("file_idx", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return samples.join(offsets, "file_idx").select("file_idx", "tr", (F.col("n") + F.col("_off")).alias("n"), "value")


def sample_rows(samples: DataFrame, by: str = "tr") -> DataFrame:
    """Wide form: one ordered array of values per transcript (by='tr') or per draw (by='n')."""
    other = "n" if by == "tr" else "tr"
    return samples.groupBy("file_idx", by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(other, "value"))), lambda s: s["value"]).alias("samples")
    )


def extract_list(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed transcripts; duplicates and ids out of range have no effect."""
    return samples.join(ids.select("tr").distinct(), "tr", "left_semi").select(samples.columns)


def extract_random(samples: DataFrame, k: int, seed: int) -> DataFrame:
    """Rows of k distinct transcripts drawn by a keyed hash, the same for every plan."""
    ids = samples.select("tr").distinct()
    chosen = ids.orderBy(rnd.portable_uniform(seed, "tr"), "tr").limit(k)
    return extract_list(samples, chosen)


def join_transcripts(samples: DataFrame, id_map: DataFrame) -> DataFrame:
    """Renumber each file's transcripts to the joint numbering."""
    m = id_map.select("file_idx", F.col("tr_in_file").alias("tr"), F.col("tr").alias("joint"))
    return samples.join(m, ["file_idx", "tr"]).select("file_idx", F.col("joint").alias("tr"), "n", "value")


def with_log(samples: DataFrame, zero: str, logged: bool = False) -> DataFrame:
    return samples if logged else samples.withColumn("value", safe_log(F.col("value"), zero))


def _numbered(samples: DataFrame) -> DataFrame:
    """Draws of each (file, transcript) series numbered 0.. in order, whatever gaps ``n`` has."""
    series = Window.partitionBy("file_idx", "tr")
    at = F.row_number().over(series.orderBy("n")).cast("long") - 1
    return samples.select("file_idx", "tr", at.alias("n"), "value", F.count(F.lit(1)).over(series).alias("_size"))


def _resampled(numbered: DataFrame, k: Column, seed: int) -> DataFrame:
    """``k`` draws with replacement from each series; a series of k stays as it is."""
    sizes = numbered.filter("n = 0").select("file_idx", "tr", "_size", k.alias("_k"))
    slots = sizes.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    drawn = F.floor(rnd.portable_uniform(seed, "file_idx", "tr", "m") * F.col("_size"))
    picks = slots.select("file_idx", "tr", "m", F.when(F.col("_size") == F.col("_k"), F.col("m")).otherwise(drawn).alias("n"))
    return picks.join(numbered, ["file_idx", "tr", "n"]).select("file_idx", "tr", F.col("m").alias("n"), "value")


def subsample(samples: DataFrame, k: int, seed: int) -> DataFrame:
    """k draws with replacement from every (file, transcript) series; a series of k stays as it is."""
    return _resampled(_numbered(samples), F.lit(k).cast("long"), seed)


def condition_align(samples: DataFrame, seed: int | None = None) -> DataFrame:
    """Replicates side by side: (tr, n) with an array of (file_idx, value), complete rows only.

    With ``seed`` longer series are resampled to the shortest one first.
    """
    files = samples.select("file_idx").distinct().agg(F.count(F.lit(1)).alias("_files"))
    if seed is not None:
        numbered = _numbered(samples)
        samples = _resampled(numbered.withColumn("_least", F.min("_size").over(Window.partitionBy("tr"))), F.col("_least"), seed)
    grouped = samples.groupBy("tr", "n").agg(F.array_sort(F.collect_list(F.struct("file_idx", "value"))).alias("reps"))
    return grouped.join(F.broadcast(files), F.size("reps") == F.col("_files")).drop("_files")  # one row


def variance_sample(samples: DataFrame, logged: bool = False, log: bool = True, k: int | None = None, seed: int = 0) -> DataFrame:
    """tr, mean, var (population) over the files' draws, log values by default.

    All draws count; ``k`` takes that many per series instead, with replacement.
    """
    if k is not None:
        samples = subsample(samples, k, seed)
    x = with_log(samples, "le0", logged or not log)
    return x.groupBy("tr").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def variance_sqdif(samples: DataFrame, logged: bool = False, log: bool = True) -> DataFrame:
    """tr, mean, var from squared differences: two halves of one file, or all draws of the first two files.

    Sums are divided by twice the number of pairs; the last draw of an odd single series has no
    partner but counts, as it always did. Draws of two files pair up in order, up to the shorter one.
    """
    x = with_log(samples, "le0", logged or not log)
    order = Window.orderBy("file_idx")
    ranked = x.select("file_idx").distinct().withColumn("_f", F.row_number().over(order) - 1)  # one row per file
    x = x.join(ranked, "file_idx")
    files = ranked.agg(F.count(F.lit(1)).alias("_files"))
    sizes = x.filter("_f = 0").groupBy("tr").agg(F.count(F.lit(1)).alias("_n"))
    paired = x.filter("_f < 2").join(sizes, "tr").join(F.broadcast(files))  # one row
    half = F.floor(F.col("_n") / 2)
    single = F.col("_files") == 1
    slot = F.when(single & (F.col("n") >= half), F.col("n") - half).otherwise(F.col("n"))
    side = F.when(single, (F.col("n") >= half).cast("int")).otherwise(F.col("_f"))
    pairs = (
        paired.withColumn("_slot", slot).withColumn("_side", side)
        .filter(~single | (F.col("_slot") < half))
        .groupBy("tr", "_slot", "_n", "_files")
        .agg(F.sum(F.when(F.col("_side") == 0, F.col("value"))).alias("a"), F.sum(F.when(F.col("_side") == 1, F.col("value"))).alias("b"))
        .filter("a is not null and b is not null")
    )
    total = F.when(F.first("_files") == 1, F.first("_n")).otherwise(2 * F.count(F.lit(1)))
    return pairs.groupBy("tr").agg(
        (F.sum(F.col("a") + F.col("b")) / total).alias("mean"), (F.sum((F.col("a") - F.col("b")) ** 2) / total).alias("var")
    )


def all_transcripts(summary: DataFrame, tr: DataFrame) -> DataFrame:
    """One row per known transcript; those without samples stay NULL and print as ``NaN 0``."""
    return tr.select(F.col("tid").alias("tr")).join(summary, "tr", "left")


def theta_to_tau(theta: DataFrame, tr: DataFrame) -> DataFrame:
    """Abundance per base, renormalised to 1 within (file, draw)."""
    lengths = tr.select(F.col("tid").alias("tr"), F.col("eff_length").alias("_eff"))
    x = theta.join(lengths, "tr").withColumn("_tau", F.col("value") / F.col("_eff"))
    sums = x.groupBy("file_idx", "n").agg(F.sum("_tau").alias("_sum"))
    tau = F.when(F.col("_tau") > 0, F.col("_tau") / F.col("_sum")).otherwise(F.col("_tau"))
    return x.join(sums, ["file_idx", "n"]).select("file_idx", "tr", "n", tau.alias("value"))


UNITS = ("theta", "counts", "rpkm", "tau")


def output_units(theta: DataFrame, kind: str, tr: DataFrame, nmap: float, lengths: str = "eff_length") -> DataFrame:
    """theta draws as theta, counts, rpkm or tau."""
    if kind == "counts":
        return theta.withColumn("value", F.col("value") * float(nmap))
    if kind == "tau":
        return theta_to_tau(theta, tr)
    if kind == "rpkm":
        by = tr.select(F.col("tid").alias("tr"), F.col(lengths).cast("double").alias("_len"))
        scaled = F.when(F.col("_len") > 0, F.col("value") * 1e9 / F.col("_len")).otherwise(F.col("value") * 1e9)
        return theta.join(by, "tr").withColumn("value", scaled).drop("_len").select(theta.columns)
    return theta


def get_counts(means: DataFrame, nmap: DataFrame) -> DataFrame:
    """Whole read counts from abundance means: means (file_idx, tr, mean), nmap (file_idx, nmap)."""
    return means.join(nmap, "file_idx").select("file_idx", "tr", F.round(F.col("mean") * F.col("nmap")).cast("long").alias("count"))

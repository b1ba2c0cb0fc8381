"""Sparse read-by-transcript operators on the long form (read_id, tr_id, lprob)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readweave.functions.numeric import BIN, group_log_sum_exp


def dedupe_alignments(hits: DataFrame) -> DataFrame:
    """Merge repeated (read, transcript) pairs by adding their probabilities."""
    return group_log_sum_exp(hits, ["read_id", "tr_id"], "lprob", "lprob")


def merge_laid_out(hits: DataFrame) -> DataFrame:
    """:func:`dedupe_alignments` of hits that are laid out by read, by one sort that steps per read go on with; no hash tables."""
    same = Window.partitionBy("read_id", "tr_id").orderBy("lprob")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value, top = F.col("lprob"), F.col("_top")
    known = F.min(value.isNotNull()).over(whole)
    topped = hits.select("read_id", "tr_id", "lprob", F.row_number().over(same).alias("_at"), F.max("lprob").over(whole).alias("_top"), known.alias("_known"))
    base = F.floor(top / BIN) * BIN  # as there, so both give the same digits
    mass = F.sum(F.exp(value - base)).over(whole)
    merged = F.when(F.col("_known") & (top > float("-inf")), base + F.log("_mass"))
    return topped.withColumn("_mass", mass).filter("_at = 1").select("read_id", "tr_id", merged.alias("lprob"))


def row_softmax(hits: DataFrame, value: str = "lprob", phi: str = "phi", log_phi: str | None = None) -> DataFrame:
    """Softmax within each read, by one pass over the hits laid out by read."""
    read = Window.partitionBy("read_id")
    topped = hits.withColumn("_top", F.max(value).over(read))
    lse = F.col("_top") + F.log(F.sum(F.exp(F.col(value) - F.col("_top"))).over(read))
    out = topped.withColumn("_lse", lse).withColumn(phi, F.exp(F.col(value) - F.col("_lse")))
    if log_phi:
        out = out.withColumn(log_phi, F.col(value) - F.col("_lse"))
    return out.drop("_lse", "_top")


def normalise_alignments(hits: DataFrame) -> DataFrame:
    """Merged alignments as probabilities that sum to 1 per read. One exchange and one sort serve merging, totals and division."""
    laid = hits.select("read_id", "tr_id", "lprob").repartition("read_id")
    return row_softmax(merge_laid_out(laid), "lprob", "prob").select("read_id", "tr_id", "prob")


def alignment_totals(hits: DataFrame) -> DataFrame:
    """m (highest transcript id + 1), n_reads, n_hits after merging."""
    merged = hits.select("read_id", "tr_id").distinct()
    per_read = merged.groupBy("read_id").agg(F.count(F.lit(1)).alias("_h"), F.max("tr_id").alias("_t"))
    return per_read.agg(
        (F.max("_t") + 1).cast("long").alias("m"), F.count(F.lit(1)).alias("n_reads"), F.sum("_h").alias("n_hits")
    )


def sum_rows(m: DataFrame, value: str) -> DataFrame:
    return m.groupBy("read_id").agg(F.sum(value).alias("total"))


def sum_cols(m: DataFrame, value: str) -> DataFrame:
    return m.groupBy("tr_id").agg(F.sum(value).alias("total"))


def count_above_delta(m: DataFrame, value: str, delta: float = 0.99) -> DataFrame:
    return m.agg(F.count_if(F.col(value) > delta).alias("above"))


def limit_alignments(hits: DataFrame, limit: int) -> DataFrame:
    """Drop every read with more than ``limit`` alignments."""
    too_many = hits.groupBy("read_id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > limit)
    return hits.join(too_many, "read_id", "left_anti")

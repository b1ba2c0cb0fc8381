"""Gene-level operators and transcript metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.functions.numeric import safe_log


def gene_index(tr: DataFrame) -> DataFrame:
    """gene, gene_idx in order of first appearance; the ordering runs over the gene table only."""
    firsts = tr.groupBy("gene").agg(F.min("tid").alias("_first"))
    from readweave.sources.lines import reindex

    return reindex(firsts, "_first", "gene_idx").select("gene", "gene_idx")


def gene_info(tr: DataFrame) -> DataFrame:
    """gene_idx, gene, transcripts, avg_length."""
    sums = tr.groupBy("gene").agg(F.count(F.lit(1)).alias("transcripts"), F.avg("length").alias("avg_length"))
    return sums.join(gene_index(tr), "gene").select("gene_idx", "gene", "transcripts", "avg_length")


def _with_tr(samples: DataFrame, tr: DataFrame) -> DataFrame:
    t = tr.select(F.col("tid").alias("tr"), "gene", F.col("length").cast("double").alias("_len"))
    return samples.join(t, "tr")


def gene_expression(
    samples: DataFrame, tr: DataFrame, adjust: bool = False, rpkm: bool = False, log: bool = False, rpkm_scale: float = 1e10
) -> DataFrame:
    """Sum of a gene's transcripts per (file, draw); ``adjust`` divides by length and renormalises.

    ``rpkm`` implies ``adjust``. Its factor is 1e10, the value existing results were made with.
    """
    x = _with_tr(samples, tr)
    adjust = adjust or rpkm
    part = F.col("value") / F.col("_len") if adjust else F.col("value")
    genes = x.groupBy("file_idx", "gene", "n").agg(F.sum(part).alias("value"))
    if adjust:
        norms = genes.groupBy("file_idx", "n").agg(F.sum("value").alias("_norm"))
        genes = genes.join(norms, ["file_idx", "n"]).withColumn(
            "value", F.when(F.col("_norm") > 0, F.col("value") / F.col("_norm")).otherwise(F.col("value"))
        )
    value = F.col("value") * rpkm_scale if rpkm else F.col("value")
    value = safe_log(value, "ieee") if log else value
    return genes.select("file_idx", "gene", "n", value.alias("value"))


def _shares(samples: DataFrame, tr: DataFrame, adjust: bool) -> DataFrame:
    x = _with_tr(samples, tr)
    part = F.col("value") / F.col("_len") if adjust else F.col("value")
    x = x.select("file_idx", "tr", "n", "gene", part.alias("_part"))
    sums = x.groupBy("file_idx", "gene", "n").agg(F.sum("_part").alias("_sum"))
    return x.join(sums, ["file_idx", "gene", "n"])


def within_gene(samples: DataFrame, tr: DataFrame, adjust: bool = False, log: bool = False) -> DataFrame:
    """Share of each transcript in its gene per draw (log: difference of logs).

    Gene totals are aggregated on the map side and joined back, so a gene holding most rows
    is never gathered in one place.
    """
    x = _shares(samples, tr, adjust)
    share = safe_log(F.col("_part"), "ieee") - safe_log(F.col("_sum"), "ieee") if log else F.try_divide("_part", "_sum")
    return x.select("file_idx", "gene", "tr", "n", share.alias("value"))


def within_gene_summary(samples: DataFrame, tr: DataFrame, adjust: bool = False, log: bool = False) -> DataFrame:
    """Mean and population variance of absolute and within-gene expression per (file, transcript)."""
    x = _shares(samples, tr, adjust)
    total = F.col("_part")
    if adjust:
        norms = x.groupBy("file_idx", "n").agg(F.sum("_part").alias("_norm"))
        x = x.join(norms, ["file_idx", "n"])
        total = safe_log(F.col("_part"), "ieee") - safe_log(F.col("_norm"), "le0") if log else (
            F.when(F.col("_norm") != 0, F.col("_part") / F.col("_norm")).otherwise(F.col("_part"))
        )
    elif log:
        total = safe_log(F.col("_part"), "ieee")
    share = safe_log(F.col("_part"), "ieee") - safe_log(F.col("_sum"), "ieee") if log else F.try_divide("_part", "_sum")
    y = x.select("file_idx", "tr", total.alias("a"), share.alias("r"))
    return y.groupBy("file_idx", "tr").agg(
        F.avg("a").alias("mean"), F.var_pop("a").alias("var"), F.avg("r").alias("mean_within"), F.var_pop("r").alias("var_within")
    )


def update_genes_map(tr: DataFrame, mapping: DataFrame) -> DataFrame:
    """Genes by transcript name; the last line of a name wins and every transcript must be found."""
    last = mapping.groupBy("transcript").agg(F.max_by("gene", "line").alias("_gene"))
    missing = F.raise_error(F.concat(F.lit("no gene for transcript "), F.col("transcript"))).cast("string")
    return tr.join(last, "transcript", "left").withColumn("gene", F.coalesce("_gene", missing)).select(tr.columns)


def update_genes_list(tr: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes by position; both sides must have the same size."""
    g = genes.select("tid", F.col("gene").alias("_gene"))
    sizes = tr.agg(F.count(F.lit(1)).alias("_a")).join(genes.agg(F.count(F.lit(1)).alias("_b")))  # one row
    wrong = F.raise_error(F.lit("gene list and transcript table differ in size")).cast("string")
    checked = F.when(F.col("_a") != F.col("_b"), wrong).otherwise(F.col("_gene"))
    return tr.join(g, "tid").join(F.broadcast(sizes)).withColumn("gene", checked).select(tr.columns)


def rename_transcripts(tr: DataFrame, names: DataFrame) -> DataFrame:
    """Transcript names by position (tid, name); names must be unique."""
    counts = names.agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("name").alias("_d"))
    dup = F.raise_error(F.lit("transcript names are not unique")).cast("string")
    checked = F.when(F.col("_n") != F.col("_d"), dup).otherwise(F.col("name"))
    return tr.join(names, "tid").join(F.broadcast(counts)).withColumn("transcript", checked).select(tr.columns)


def check_gene_count(tr: DataFrame) -> DataFrame:
    """transcripts, genes, ok: one gene for all, or one per transcript, is suspicious."""
    c = tr.agg(F.count(F.lit(1)).alias("transcripts"), F.countDistinct("gene").alias("genes"))
    return c.withColumn("ok", (F.col("genes") != 1) & (F.col("genes") != F.col("transcripts")))


def check_tr_grouping(tr: DataFrame) -> DataFrame:
    """gene, transcripts, islands: more than one island means the gene is not contiguous.

    An island starts where the previous position has another gene; neighbours meet by an
    equi-join on position instead of a window over the whole table.
    """
    previous = tr.select((F.col("tid") + 1).alias("tid"), F.col("gene").alias("_prev"))
    starts = tr.join(previous, "tid", "left").withColumn(
        "_start", (F.col("_prev").isNull() | (F.col("_prev") != F.col("gene"))).cast("long")
    )
    return starts.groupBy("gene").agg(F.count(F.lit(1)).alias("transcripts"), F.sum("_start").alias("islands"))


def check_lengths(tr: DataFrame, seqs: DataFrame) -> DataFrame:
    """transcripts, compared, mismatched: declared length against the sequence."""
    j = tr.select("tid", "length").join(seqs.select("tid", F.length("seq").alias("_l")), "tid", "left")
    return j.agg(
        F.count(F.lit(1)).alias("transcripts"),
        F.count("_l").alias("compared"),
        F.count_if(F.col("_l") != F.col("length")).alias("mismatched"),
    )

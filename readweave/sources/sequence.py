"""FASTA, GTF and genome readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.functions.text import gtf_attribute, tokens
from readweave.sources.lines import read_lines, reindex

LINE_WIDTH = 70


def read_fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """tid, header (without '>'), seq, seq_lines. One row per record, whatever its line widths."""
    rows = read_lines(spark, path, lineSep="\n>").filter(F.trim("value") != "")
    record = F.regexp_replace("value", r"^\s*>", "")
    parts = rows.select("row_idx", F.split(F.regexp_replace(record, "\r", ""), "\n", 2).alias("p"))
    body = F.coalesce(F.get("p", F.lit(1)), F.lit(""))
    records = parts.select("row_idx", F.col("p")[0].alias("header"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return reindex(records, "row_idx", "tid").select("tid", "header", "seq")


def standard_gene(header: Column) -> Column:
    """Gene after ' gene:' or 'gene=', NULL when the header names none."""
    found = F.regexp_extract(header, r"(?: gene:|gene=)(\S+)", 1)
    return F.when(found == "", F.lit(None)).otherwise(found)


def gencode_names(header: Column) -> tuple[Column, Column]:
    """(transcript, gene) of a bar-separated header; the gene is NULL without a second field."""
    fields = tokens(header, r"\|")
    return F.try_element_at(fields, F.lit(1)), F.try_element_at(fields, F.lit(2))


def name_records(records: DataFrame, style: str = "standard") -> DataFrame:
    """tid, name, gene, seq. One header without a gene switches genes off for every record."""
    if style == "gencode":
        name, gene = gencode_names(F.col("header"))
    else:
        name, gene = tokens(F.col("header"))[0], standard_gene(F.col("header"))
    named = records.select("tid", name.alias("name"), gene.alias("_gene"), "seq")
    complete = named.agg(F.bool_and(F.col("_gene").isNotNull()).alias("_all"))
    return named.join(F.broadcast(complete)).select(  # one row
        "tid", "name", F.when(F.col("_all"), F.col("_gene")).otherwise(F.lit("none")).alias("gene"), "seq"
    )


def read_fasta(spark: SparkSession, path: str, style: str = "standard") -> DataFrame:
    return name_records(read_fasta_records(spark, path), style)


def wrap(seq: Column, width: int = LINE_WIDTH) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def write_fasta(df: DataFrame, path: str, header: Column, seq: str = "seq", order: str = "tid") -> None:
    """Records in ``order``, sequence wrapped at 70 columns."""
    text = F.concat(F.lit(">"), header, F.lit("\n"), wrap(F.col(seq)))
    df.orderBy(order).select(text.alias("value")).write.text(path)


def gencode_header(attrs: str = "attribute", seq: str = "seq") -> Column:
    a = F.col(attrs)

    def attr(name: str, missing: Column) -> Column:
        v = gtf_attribute(a, name)
        return F.when(v == "", missing).otherwise(v)

    gene = gtf_attribute(a, "gene_id")
    dash, empty = F.lit("-"), F.lit("")
    parts = [
        attr("transcript_id", gene), gene, attr("havana_gene", dash), attr("havana_transcript", dash),
        attr("transcript_name", empty), attr("gene_name", empty), F.length(seq).cast("string"),
    ]
    return F.concat(F.concat_ws("|", *parts), F.lit("|"))


def ensembl_header(attrs: str = "attribute") -> Column:
    a = F.col(attrs)
    gene = gtf_attribute(a, "gene_id")
    tid = gtf_attribute(a, "transcript_id")
    biotype = F.when(gtf_attribute(a, "gene_biotype") == "", F.lit("N/A")).otherwise(gtf_attribute(a, "gene_biotype"))
    place = F.concat_ws(
        ":", F.lit("chromosome:N/A"), F.col("seqname"), F.col("start").cast("string"), F.col("end").cast("string"),
        F.when(F.col("strand") == "+", "1").otherwise("-1"),
    )
    return F.concat_ws(
        " ", F.when(tid == "", gene).otherwise(tid), F.lit("cdna:N/A"), place, F.concat(F.lit("gene:"), gene),
        F.concat(F.lit("gene_biotype:"), biotype), F.concat(F.lit("transcript_biotype:"), biotype),
    )


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Gene and exon features of tab-separated ``value`` lines."""
    f = F.split("value", "\t")
    typed = lines.filter(~F.col("value").startswith("#")).select(
        f[0].alias("seqname"), f[1].alias("source"), f[2].alias("feature"), f[3].cast("long").alias("start"),
        f[4].cast("long").alias("end"), F.coalesce(F.regexp_extract(f[5], r"^\s*([+-]?\d+)", 1).try_cast("double"), F.lit(0.0)).alias("score"),
        f[6].alias("strand"), f[7].alias("frame"), f[8].alias("attribute"),
    )
    return typed.filter(F.col("feature").isin("gene", "exon")).withColumn("gene_id", gtf_attribute(F.col("attribute"), "gene_id"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF, plain or gzip."""
    return parse_gtf(spark.read.text(path))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """chromosome, seq."""
    return read_fasta_records(spark, path).select(tokens(F.col("header"))[0].alias("chromosome"), "seq")


def strip_tail(seq: Column) -> Column:
    """Drop a tail of characters that are no base codes."""
    other = "[^ACGTURYKMSWBDHVNacgturykmswbdhvn-]"
    # the search goes through the whole text, so only where the last character calls for it
    return F.when(F.right(seq, F.lit(1)).rlike(other), F.regexp_replace(seq, f"{other}+$", "")).otherwise(seq)


def genome_slice(spans: DataFrame, genome: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq: bases start..end (1-based, inclusive) of each distinct span's chromosome."""
    from readweave.operators.blocks import long_slices

    named = genome.withColumnRenamed("chromosome", "seqname")
    return long_slices(spans.select(keys).distinct(), named, keys, "seqname", "start", "end").select(*keys, strip_tail(F.col("_piece")).alias("seq"))

"""Readers of the whitespace-separated pipeline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.functions.text import tokens
from readweave.sources.lines import data_lines, number, read_header

# Fixed values written for text that is not a number in sample files.
MINUS_INF = -47.0
PLUS_INF = 1e10


def read_tr(spark: SparkSession, path: str) -> DataFrame:
    """tid, gene, transcript, length, eff_length (length when the column is missing)."""
    words = data_lines(spark, path).select("line", tokens(F.col("value")).alias("w"))
    return words.select(
        F.col("line").alias("tid"),
        F.col("w")[0].alias("gene"),
        F.col("w")[1].alias("transcript"),
        F.col("w")[2].cast("int").alias("length"),
        F.coalesce(F.try_element_at("w", F.lit(4)).cast("double"), F.col("w")[2].cast("double")).alias("eff_length"),
    )


def prob_hits(tokens_col, layout: str):
    """Array of (tid, value) structs of one alignment line; see :func:`read_prob`."""
    step, first = (3, 3) if layout == "OLD" else (2, 2)
    count = F.greatest(tokens_col[1].cast("int"), F.lit(0))

    def hit(i):
        base = F.lit(first) + i * step
        return F.struct(
            F.get(tokens_col, base).try_cast("int").alias("tr_id"),
            number(F.get(tokens_col, base + step - 1)).alias("value"),
        )

    hits = F.transform(F.sequence(F.lit(0), count - 1), hit)
    return F.when(count == 0, F.slice(hits, 1, 0)).otherwise(hits)


def read_prob(
    spark: SparkSession, path: str, tr: DataFrame | None = None, on_corrupt: str = "noise", allow_old: bool = True
) -> DataFrame:
    """Read-to-transcript probabilities: read_id, read_idx, tr_id, lprob.

    LOG files hold logs, the others probabilities; OLD files divide by transcript length, so
    they need ``tr``. An unreadable hit drops the rest of its line and becomes noise of weight
    10 on the file's own scale, or raises with ``on_corrupt='error'``.
    """
    header = read_header(spark, path)
    layout = "LOG" if "LOGFORMAT" in header else "NEW" if "NEWFORMAT" in header else "OLD"
    if layout == "OLD" and not allow_old:
        raise ValueError("this estimator does not read the old alignment layout")
    lines = data_lines(spark, path)
    if header.get("Nmap"):
        lines = lines.filter(F.col("line") < header["Nmap"])
    words = lines.select("line", tokens(F.col("value")).alias("w"))
    hits = words.select("line", F.col("w")[0].alias("read_id"), prob_hits(F.col("w"), layout).alias("h"))
    bad = F.array_position(F.transform("h", lambda x: x["tr_id"].isNull() | x["value"].isNull()), True)
    if on_corrupt == "error":
        message = F.concat(F.lit("unreadable alignment of read "), F.col("read_id"))
        hits = hits.withColumn("h", F.when(bad > 0, F.raise_error(message).cast("array<struct<tr_id:int,value:double>>")).otherwise(F.col("h")))
    else:
        noise = F.array(F.struct(F.lit(0).alias("tr_id"), F.lit(10.0).alias("value")))
        kept = F.concat(F.slice("h", F.lit(1), F.greatest(bad.cast("int") - 1, F.lit(0))), noise)
        hits = hits.withColumn("h", F.when(bad > 0, kept).otherwise(F.col("h")))
    long = hits.select("read_id", F.col("line").alias("read_idx"), F.explode_outer("h").alias("h")).select(
        "read_id", "read_idx", F.col("h.tr_id").alias("tr_id"), F.col("h.value").alias("value")
    ).filter("tr_id is not null")
    if layout == "LOG":
        return long.withColumnRenamed("value", "lprob")
    if layout == "OLD":
        if tr is None:
            raise ValueError("the old layout needs transcript lengths")
        lengths = tr.select((F.col("tid") + 1).alias("tr_id"), F.col("length").alias("_len"))
        long = long.join(lengths, "tr_id", "left").withColumn(
            "value", F.when(F.col("tr_id") != 0, F.col("value") / F.col("_len")).otherwise(F.col("value"))
        )
    return long.select("read_id", "read_idx", "tr_id", F.when(F.col("value") > 0, F.log("value")).otherwise(F.lit(-100.0)).alias("lprob"))


def read_samples(spark: SparkSession, path: str, file_idx: int = 0, norm: float = 1.0) -> DataFrame:
    """Posterior samples of one file in long form: file_idx, tr, n, value.

    Flag T says lines are transcripts, otherwise lines are draws. ``norm`` multiplies raw values,
    logged or not. The literals -inf and nan load as the fixed stand-ins.
    """
    header = read_header(spark, path)
    line, pos = ("tr", "n") if "T" in header else ("n", "tr")
    cells = data_lines(spark, path).select("line", F.posexplode_outer(tokens(F.col("value"))).alias("pos", "token"))
    word = F.lower("token")
    value = (
        F.when(word == "-inf", F.lit(MINUS_INF))
        .when(word == "nan", F.lit(PLUS_INF))
        .otherwise(F.col("token").cast("double") * norm)
    )
    return cells.select(
        F.lit(file_idx).alias("file_idx"),
        F.col("line").cast("long").alias(line),
        F.col("pos").cast("long").alias(pos),
        value.alias("value"),
    ).select("file_idx", "tr", "n", "value")


def guess_expression_layout(path: str) -> str:
    ext = path.rsplit(".", 1)[-1]
    if ext == "thetaMeans":
        return "theta_means"
    if ext == "m_alphas":
        return "m_alphas"
    if ext.endswith(("mean", "variance", "var")):
        return "mean_variance"
    return "theta_means"


def read_expression(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """tr, expr, var from a means, mean/variance or Dirichlet-parameter table."""
    layout = layout or guess_expression_layout(path)
    words = data_lines(spark, path).select("line", tokens(F.col("value")).alias("w"))

    def num(i: int):
        return number(F.col("w")[i])

    if layout == "theta_means":
        return words.select((F.col("w")[0].cast("long") - 1).alias("tr"), num(1).alias("expr"), num(4).alias("var"))
    if layout == "mean_variance":
        return words.select(F.col("line").alias("tr"), num(0).alias("expr"), num(1).alias("var"))
    rows = words.select("line", num(1).alias("alpha"), num(2).alias("beta"))
    return expression_from_alphas(rows.select((F.col("line") - 1).alias("tr"), "alpha", "beta"))


def expression_from_alphas(alphas: DataFrame) -> DataFrame:
    """Mean and variance of each transcript; row tr = -1 is noise, its beta sums all others."""
    total = alphas.filter("tr = -1").agg(F.first("beta").alias("b0"))
    return (
        alphas.filter("tr >= 0")
        .join(F.broadcast(total))  # one row
        .select(
            "tr",
            (F.col("alpha") / F.col("b0")).alias("expr"),
            (F.col("alpha") * (F.col("b0") - F.col("alpha")) / (F.col("b0") * F.col("b0") * (F.col("b0") + 1))).alias("var"),
        )
    )


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Hyperparameter curve: expr, alpha, beta ordered by expr."""
    words = data_lines(spark, path).select(tokens(F.col("value")).alias("w"))
    return words.select(
        F.col("w")[2].cast("double").alias("expr"), F.col("w")[0].cast("double").alias("alpha"), F.col("w")[1].cast("double").alias("beta")
    ).orderBy("expr")


def read_tr_map(spark: SparkSession, path: str) -> DataFrame:
    """gene, transcript, line: a later line for the same transcript wins."""
    words = data_lines(spark, path).select("line", tokens(F.col("value")).alias("w"))
    return words.select(F.col("w")[0].alias("gene"), F.col("w")[1].alias("transcript"), "line")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """tid, gene by position."""
    return data_lines(spark, path).select(F.col("line").alias("tid"), tokens(F.col("value"))[0].alias("gene"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct transcript ids of a whitespace-separated select file."""
    ids = spark.read.text(path).select(F.explode(tokens(F.col("value"))).alias("t"))
    return ids.select(F.col("t").cast("long").alias("tr")).distinct()


def read_transcript_join(spark: SparkSession, path: str) -> DataFrame:
    """Positional id map of several files: tr, file_idx, tr_in_file."""
    words = data_lines(spark, path).select(tokens(F.col("value")).alias("w"))
    return words.select(F.col("w")[0].cast("long").alias("tr"), F.posexplode(F.slice("w", F.lit(2), F.size("w"))).alias("file_idx", "t")).select(
        "tr", "file_idx", F.col("t").cast("long").alias("tr_in_file")
    )


def read_mcmc_params(spark: SparkSession, path: str) -> dict[str, str]:
    """``name value`` pairs of a sampler parameter file; '#' starts a comment."""
    out: dict[str, str] = {}
    for row in spark.read.text(path).toLocalIterator():
        words = row.value.split("#", 1)[0].split()
        if len(words) >= 2:
            out[words[0]] = words[1]
    return out

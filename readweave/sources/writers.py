"""Text exports of every pipeline table. Canonical storage is Parquet; these are for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_with_header(lines: DataFrame, path: str, header: list[str], mode: str = "errorifexists") -> None:
    """``lines`` has one string column, already ordered; the header goes to the first part file."""
    spark = lines.sparkSession
    top = spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1)
    body = lines.toDF("value")
    (top.union(body) if header else body).write.mode(mode).text(path)


def sci(x: Column) -> Column:
    """Nine decimals, scientific."""
    return F.format_string("%.9e", x.cast("double"))


def join_words(*cols: Column | str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])


def prob_lines(hits: DataFrame) -> DataFrame:
    """``name n (tid lprob)*`` with the noise hit last; input read_id, read_idx, tr_id, lprob."""
    entry = F.struct((F.col("tr_id") == 0).alias("noise"), "tr_id", "lprob")
    per_read = hits.groupBy("read_id", "read_idx").agg(F.array_sort(F.collect_list(entry)).alias("h"))
    pairs = F.transform("h", lambda x: F.concat_ws(" ", x["tr_id"].cast("string"), x["lprob"].cast("string")))
    return per_read.orderBy("read_idx").select(
        F.concat_ws(" ", F.col("read_id"), F.size("h").cast("string"), F.concat_ws(" ", pairs)).alias("value")
    )


def write_prob(hits: DataFrame, path: str, n_total: int, n_map: int, m: int) -> None:
    header = [f"# Ntotal {n_total}", f"# Nmap {n_map}", f"# M {m}", "# LOGFORMAT", "# r_name num_alignments (tr_id prob )^*{num_alignments}"]
    write_with_header(prob_lines(hits), path, header)


def write_tr(tr: DataFrame, path: str, force: bool = False) -> str:
    """Transcript table; an existing target is kept and ``path-NEW`` used instead unless forced."""
    m = tr.count()
    lines = tr.orderBy("tid").select(
        F.concat_ws(" ", "gene", "transcript", F.col("length").cast("string"), F.col("eff_length").cast("string"))
    )
    header = [f"# M {m}"]
    try:
        write_with_header(lines, path, header, "overwrite" if force else "errorifexists")
        return path
    except Exception as exc:  # only the "already there" case has a second target
        if "PATH_ALREADY_EXISTS" not in str(exc):
            raise
        write_with_header(lines, path + "-NEW", header)
        return path + "-NEW"


def write_gene_info(genes: DataFrame, path: str) -> None:
    lines = genes.orderBy("gene_idx").select(join_words("gene", "transcripts", "avg_length"))
    write_with_header(lines, path, [f"# G {genes.count()}", "# gene_name transcripts_count average_length"])


def write_samples(samples: DataFrame, path: str, logged: bool = False, transposed: bool = True) -> None:
    """Matrix text of long samples (tr, n, value); one line per transcript, or per draw."""
    line, pos = ("tr", "n") if transposed else ("n", "tr")
    dims = samples.agg((F.max("tr") + 1).alias("m"), (F.max("n") + 1).alias("n")).first()
    rows = samples.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(pos, "value"))).alias("v"))
    text = F.concat_ws(" ", F.transform("v", lambda x: F.format_string("%.9e", x["value"])))
    header = [" ".join(["#"] + ["T"] * transposed + ["L"] * logged), f"# M {dims['m']}", f"# N {dims['n']}"]
    write_with_header(rows.orderBy(line).select(text), path, header)


def write_theta_means(means: DataFrame, path: str, m: int) -> None:
    """id, mean, count, mean logit theta, variance, chain means."""
    chain = F.concat_ws(" ", F.transform("chain_means", lambda v: F.format_string("%.9e", v)))
    lines = means.orderBy("tr").select(
        join_words(F.col("tr").cast("string"), sci(F.col("mean_theta")), F.col("mean_count").cast("string"), sci(F.col("mean_logit_theta")), sci(F.col("var_theta")), chain)
    )
    write_with_header(lines, path, [f"# M {m}", "# id meanTheta meanReadCount meanThetaSaved varTheta (chain means)"])


def write_alphas(alphas: DataFrame, path: str, m: int) -> None:
    lines = alphas.orderBy("tr").select(join_words(sci(F.col("mean_theta")), sci(F.col("alpha")), sci(F.col("beta"))))
    write_with_header(lines, path, [f"# M {m}", "# meanTheta alpha beta (first row is noise)"])


def write_phi(phi: DataFrame, path: str, n_total: int, n_map: int, m: int) -> None:
    """Posterior assignment of every read."""
    renamed = phi.select("read_id", "read_idx", "tr_id", F.col("phi").alias("lprob"))
    write_with_header(prob_lines(renamed), path, [f"# Ntotal {n_total}", f"# Nmap {n_map}", f"# M {m}", "# NEWFORMAT"])


def write_mean_variance(df: DataFrame, path: str, logged: bool) -> None:
    """mean var per transcript; a transcript without samples reads ``NaN 0``."""
    text = F.when(F.col("mean").isNull(), F.lit("NaN 0")).otherwise(join_words(sci(F.col("mean")), sci(F.col("var"))))
    header = (["# L"] if logged else []) + [f"# M {df.count()}", "# <mean> <variance>"]
    write_with_header(df.orderBy("tr").select(text), path, header)


def write_params(params: DataFrame, path: str, lambda0: float) -> None:
    lines = params.orderBy("expr").select(join_words("alpha", "beta", "expr"))
    write_with_header(lines, path, [f"# lambda0 {lambda0}", f"# PN {params.count()} hyperparameters", "# columns: alpha beta expression"])


def write_columns(df: DataFrame, path: str, columns: list[str], order: list[str], header: list[str]) -> None:
    """Any per-transcript report: .pplr, fold changes, log ratios, profiles."""
    write_with_header(df.orderBy(*order).select(join_words(*columns)), path, header)


def write_names(names: DataFrame, path: str) -> None:
    """Distinct read names, sorted."""
    names.distinct().orderBy(names.columns[0]).write.text(path)

"""Registered round trips through the exchange files: each writes a report and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.functions.text import tokens
from readweave.operators import contrasts, convergence, genes, hits, samples
from readweave.plans.domain import Domain, with_views
from readweave.plans.inference_queries import _M
from readweave.plans.sample_queries import ORACLE as SAMPLE_SQL
from readweave.plans.sample_queries import rounded
from readweave.session import scratch_path
from readweave.sources import tables, writers
from readweave.sources.lines import data_lines

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str, digits: int | None = 6):
    def register(fn):
        def run(spark, sf_dir):
            out = fn(Domain(spark, sf_dir))
            return out if digits is None else rounded(out, digits)

        QUERIES[name] = run
        ORACLE[name] = sql if sql.startswith("WITH") else with_views(sql)
        return fn

    return register


def _text_file(lines: DataFrame, d: Domain, label: str) -> str:
    path = scratch_path(d.spark, label)
    lines.write.text(path)
    return path


# Posterior alphas after one softmax over merged hits: one plus the expected reads.
_ALPHAS = f"SELECT t.tr_id, 1 + coalesce(s, 0) AS alpha FROM (SELECT unnest(range({_M})) AS tr_id) t LEFT JOIN (SELECT tr_id, sum(prob) AS s FROM probs GROUP BY 1) USING (tr_id)"


@query(
    "alphas_file",
    f"""SELECT tr_id - 1 AS tr, round(alpha/b0, 6) AS expr, round(alpha*(b0-alpha)/(b0*b0*(b0+1)), 9) AS var
    FROM ({_ALPHAS}), (SELECT sum(alpha) AS b0 FROM ({_ALPHAS}) WHERE tr_id > 0) WHERE tr_id > 0""",
    None,
)
def _(d):
    sums = hits.sum_cols(hits.normalise_alignments(d.hits), "prob")
    alphas = d.spark.range(d.n_transcripts).select(F.col("id").alias("tr_id")).join(sums, "tr_id", "left").select("tr_id", (F.coalesce("total", F.lit(0.0)) + 1).alias("alpha"))
    whole = alphas.agg(F.sum("alpha").alias("t"))
    full = alphas.join(F.broadcast(whole)).select(F.col("tr_id").alias("tr"), (F.col("alpha") / F.col("t")).alias("mean_theta"), "alpha", (F.col("t") - F.col("alpha")).alias("beta"))  # one row
    path = scratch_path(d.spark, "fit") + ".m_alphas"
    writers.write_alphas(full, path, d.n_transcripts)
    return tables.read_expression(d.spark, path).select("tr", F.round("expr", 6).alias("expr"), F.round("var", 9).alias("var"))


@query("phi_file", "SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(tr_id AS INT) AS tr_id, round(CASE WHEN prob > 0 THEN ln(prob) ELSE -100 END, 4) AS lprob FROM probs", 4)
def _(d):
    phi = hits.normalise_alignments(d.hits).select(F.col("read_id").cast("string").alias("read_id"), F.col("read_id").alias("read_idx"), "tr_id", F.col("prob").alias("phi"))
    n, path = phi.select("read_id").distinct().count(), scratch_path(d.spark, "phi")
    writers.write_phi(phi, path, n, n, d.n_transcripts)
    return tables.read_prob(d.spark, path).select("read_id", "tr_id", "lprob")


@query("theta_means_file", "SELECT tr - 1 AS tr, round(avg(theta), 8) AS expr, round(var_samp(theta), 8) AS var FROM chains GROUP BY tr", 8)
def _(d):
    path = scratch_path(d.spark, "run") + ".thetaMeans"
    writers.write_theta_means(convergence.theta_means(d.chains, 1_000_000), path, d.n_transcripts)
    return tables.read_expression(d.spark, path)


@query("samples_file_by_draw", "SELECT 0 AS file_idx, dense_rank() OVER (ORDER BY tr) - 1 AS tr, n, round(value, 2) AS value FROM (SELECT tr, n, sum(value) AS value FROM samples GROUP BY tr, n) WHERE n IN (SELECT n FROM samples GROUP BY n HAVING count(DISTINCT tr) = (SELECT count(DISTINCT tr) FROM samples))", 2)
def _(d):
    cells = d.series.groupBy("tr", "n").agg(F.sum("value").alias("value"))
    every = cells.select("tr").distinct().count()
    whole = cells.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == every).select("n")
    full = cells.join(whole, "n")
    order = [r["n"] for r in whole.orderBy("n").collect()]  # draws are months, so a few
    path = scratch_path(d.spark, "draws")
    writers.write_samples(full, path, transposed=False)
    number = d.spark.createDataFrame(list(enumerate(order)), "line long, n long")
    return tables.read_samples(d.spark, path).withColumnRenamed("n", "line").join(F.broadcast(number), "line").select("file_idx", "tr", "n", "value")


@query("gene_info_file", SAMPLE_SQL["gene_info"].replace("round(avg_length,6)", "round(avg_length,4)"), 4)
def _(d):
    path = scratch_path(d.spark, "genes")
    writers.write_gene_info(genes.gene_info(d.trs), path)
    w = F.col("w")
    words = data_lines(d.spark, path).select("line", tokens(F.col("value")).alias("w"))
    return words.select(F.col("line").cast("long").alias("gene_idx"), w[0].alias("gene"), w[1].cast("long").alias("transcripts"), w[2].cast("double").alias("avg_length"))


@query("pplr_file", SAMPLE_SQL["pplr"])
def _(d):
    names = ["tr", "pplr", "log2fc", "ci_low", "ci_high", "mean_a", "mean_b"]
    path = scratch_path(d.spark, "report")
    writers.write_columns(contrasts.pplr(d.series, first=0, second=3), path, names, ["tr"], ["# " + " ".join(names)])
    words = data_lines(d.spark, path).select(tokens(F.col("value")).alias("w"))
    return words.select(F.col("w")[0].cast("long").alias("tr"), *[F.col("w")[i].cast("double").alias(c) for i, c in enumerate(names) if i])


@query("names_file", "SELECT DISTINCT read_id AS name FROM frags WHERE NOT paired", None)
def _(d):
    path = scratch_path(d.spark, "failed")
    alone = d.frags.filter(~F.col("paired")).select(F.col("first.qname").alias("name"))
    writers.write_names(alone, path)
    return d.spark.read.text(path).select(F.col("value").alias("name"))


@query("select_file", "SELECT file_idx, tr, n, value FROM samples WHERE tr IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)", None)
def _(d):
    wanted = d.table("supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("value"))
    return samples.extract_list(d.series, tables.read_id_list(d.spark, _text_file(wanted, d, "select")))


@query("transcript_join_file", "SELECT file_idx, tr + 7 AS tr, n, value FROM samples WHERE (file_idx, tr) IN (SELECT file_idx, tr FROM samples)", None)
def _(d):
    files = d.series.select("file_idx").distinct().count()
    ids = d.series.select("tr").distinct()
    line = F.concat_ws(" ", (F.col("tr") + 7).cast("string"), *[F.col("tr").cast("string") for _ in range(files)])
    return samples.join_transcripts(d.series, tables.read_transcript_join(d.spark, _text_file(ids.select(line.alias("value")), d, "join")))


@query("theta_to_rpkm", "SELECT file_idx, tr, n, round(value*1e9/eff_length, 3) AS value FROM theta JOIN trs ON tid = tr", 3)
def _(d):
    return samples.output_units(d.theta, "rpkm", d.trs, 1.0)


@query("theta_to_counts", "SELECT file_idx, tr, n, round(value*2500, 6) AS value FROM theta")
def _(d):
    return samples.output_units(d.theta, "counts", d.trs, 2500)

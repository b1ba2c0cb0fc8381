"""Registered queries over posterior samples, genes and contrasts, with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.functions.order import credible_interval
from readweave.functions.random import TRIES
from readweave.operators import annotation, contrasts, convergence, genes, samples
from readweave.operators import expression as de
from readweave.operators import hyper, smoothing
from readweave.plans.domain import Domain, with_views
from readweave.session import cut_lineage

QUERIES = {}
ORACLE = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int | None = 6):
    def register(fn):
        def run(spark, sf_dir):
            out = fn(Domain(spark, sf_dir))
            return out if digits is None else rounded(out, digits)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_views(sql)
        return fn

    return register


LN2 = "ln(2::DOUBLE)"
NMAP = 1_000_000.0

# ---- unit conversions

_CONVERSIONS = {
    "c2r": ("C2R", NMAP, "value/(1e-9*1000000.0)/eff_length", None),
    "r2c": ("R2C", NMAP, "value*1e-9*1000000.0*eff_length", None),
    "t2r": ("T2R", None, "value/1e-9/eff_length", None),
    "r2t": ("R2T", None, "value*1e-9*eff_length", None),
    "t2rl": ("T2RL", None, "ln(value/eff_length)+ln(1e9)", 6),
    "norm": ("NORM", 0.5, "value*0.5", None),
    "lognorm": ("LOGNORM", 0.5, "ln(value)+ln(0.5)", 6),
}
for _key, (_action, _nmap, _sql, _digits) in _CONVERSIONS.items():

    def _make(action=_action, nmap=_nmap):
        return lambda d: samples.convert(d.series, action, d.trs, nmap)

    _expr = _sql.replace("1e-9", "1e-9::DOUBLE").replace("1000000.0", "1000000::DOUBLE").replace("0.5", "0.5::DOUBLE")
    query(f"convert_{_key}", f"SELECT file_idx, tr, n, {_expr if _digits is None else f'round({_expr}, {_digits})'} AS value FROM samples JOIN trs ON tid = tr", _digits)(_make())

CONSTANTS = [1.5, 2.0, 0.5, 0.25, 4.0, 1.0]


@query("apply_norm", "SELECT file_idx, tr, n, value*(CAST([1.5,2,0.5,0.25,4,1] AS DOUBLE[]))[file_idx+1] AS value FROM samples", None)
def _(d):
    return samples.apply_norm(d.series, CONSTANTS)


@query(
    "transpose_merge",
    """SELECT file_idx, tr, n + off AS n, value FROM samples JOIN (SELECT file_idx, coalesce(sum(mx) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS off
    FROM (SELECT file_idx, max(n)+1 AS mx FROM samples GROUP BY file_idx)) USING (file_idx)""",
)
def _(d):
    return samples.merge_files(d.series)


@query("sample_rows", "SELECT file_idx, tr, list(value ORDER BY n) AS samples FROM samples GROUP BY file_idx, tr", None)
def _(d):
    return samples.sample_rows(d.series)


@query("theta_to_tau", "SELECT file_idx, tr, n, round((value/eff_length)/sum(value/eff_length) OVER (PARTITION BY file_idx, n), 9) AS value FROM theta JOIN trs ON tid=tr", 9)
def _(d):
    return samples.theta_to_tau(d.theta, d.trs)


@query(
    "get_counts",
    """SELECT file_idx, tr, CAST(round(m*nmap) AS BIGINT) AS count FROM (SELECT file_idx, tr, avg(value) AS m FROM theta GROUP BY 1,2)
    JOIN (SELECT file_idx, count(*)*1000 AS nmap FROM samples GROUP BY 1) USING (file_idx)""",
)
def _(d):
    means = d.theta.groupBy("file_idx", "tr").agg(F.avg("value").alias("mean"))
    nmap = d.series.groupBy("file_idx").agg((F.count(F.lit(1)) * 1000).alias("nmap"))
    return samples.get_counts(means, nmap)


# ---- selection and alignment of files


@query("extract_list", "SELECT file_idx, tr, n, value FROM samples WHERE tr IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(d):
    wanted = d.table("supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("tr"))
    return samples.extract_list(d.series, wanted.unionByName(wanted))


def _u(seed: int, *keys: str) -> str:
    """SQL of the portable uniform."""
    text = "concat_ws('|', '%d', %s)" % (seed, ", ".join(keys))
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE)"


def gamma_sql(rel: str, keys: str, seed: int, shape: str) -> str:
    """SQL of the gamma draws: the columns of ``rel`` and ``g``. ``keys`` tell its rows apart."""

    def u(*more: str) -> str:
        return _u(seed, keys, *more)

    lifted = f"CASE WHEN {shape} < 1 THEN {shape} + 1 ELSE {shape} END - 1::DOUBLE / 3"
    tries = f"""SELECT {keys}, t, d, z, 1 + z / sqrt(9 * d) AS w, {u('t', "'s'")} AS c FROM (
        SELECT *, sqrt(-2 * ln(1 - {u('t', "'r'")})) * cos(2 * pi() * {u('t', "'a'")}) AS z FROM (SELECT {keys}, {lifted} AS d, unnest(range({TRIES})) AS t FROM ({rel})))"""
    kept = f"SELECT {keys}, arg_min(d * (w * w * w), t) AS v FROM ({tries}) WHERE w > 0 AND ln(1 - c) < 0.5::DOUBLE * z * z + d * (1 - w * w * w + 3 * ln(greatest(w, 1e-300::DOUBLE))) GROUP BY ALL"
    return f"""SELECT *, coalesce(v, {lifted}) * CASE WHEN {shape} < 1 THEN pow({u("'p'")}, 1 / {shape}) ELSE 1 END AS g FROM ({rel}) LEFT JOIN ({kept}) USING ({keys})"""


def normal_sql(seed: int, *keys: str) -> str:
    return f"""sqrt(-2 * ln(1 - {_u(seed, *keys, "'r'")})) * cos(2 * pi() * {_u(seed, *keys, "'a'")})"""


_NUMBERED = "SELECT file_idx, tr, row_number() OVER (PARTITION BY file_idx, tr ORDER BY n) - 1 AS n, value, count(*) OVER (PARTITION BY file_idx, tr) AS size FROM samples"


def _resampled(k: str, seed: int) -> str:
    return f"""SELECT file_idx, tr, m AS n, value FROM (SELECT file_idx, tr, m, CASE WHEN size = k THEN m ELSE floor({_u(seed, 'file_idx', 'tr', 'm')} * size)::BIGINT END AS n
    FROM (SELECT file_idx, tr, size, k, unnest(range(0, k)) AS m FROM (SELECT file_idx, tr, size, {k} AS k FROM ({_NUMBERED}) WHERE n = 0))) JOIN ({_NUMBERED}) USING (file_idx, tr, n)"""


@query("extract_random", f"SELECT file_idx, tr, n, value FROM samples WHERE tr IN (SELECT tr FROM (SELECT DISTINCT tr FROM samples) ORDER BY {_u(7, 'tr')}, tr LIMIT 20)")
def _(d):
    return samples.extract_random(d.series, 20, seed=7)


@query("subsample", _resampled("64", 5))
def _(d):
    return samples.subsample(d.series, 64, seed=5)


def merged_single(d: Domain) -> DataFrame:
    """All draws of a transcript renumbered 0.. within its file (series are short: months)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("file_idx", "tr").orderBy("n")) - 1
    return d.series.withColumn("n", rank.cast("long"))


@query("join_transcripts", "SELECT file_idx, tr + 1000 * file_idx + 7 AS tr, n, value FROM samples")
def _(d):
    files = d.series.select("file_idx", "tr").distinct()
    id_map = files.select("file_idx", F.col("tr").alias("tr_in_file"), (F.col("tr") + 1000 * F.col("file_idx") + 7).alias("tr"))
    return samples.join_transcripts(d.series, id_map)


@query(
    "condition_align",
    """SELECT tr, n, list(file_idx ORDER BY file_idx) AS files, round(sum(value), 2) AS total FROM samples GROUP BY tr, n
    HAVING count(*) = (SELECT count(DISTINCT file_idx) FROM samples)""",
    2,
)
def _(d):
    a = samples.condition_align(d.series)
    return a.select("tr", "n", F.transform("reps", lambda r: r["file_idx"]).alias("files"), F.aggregate("reps", F.lit(0.0), lambda x, r: x + r["value"]).alias("total"))


@query(
    "condition_resample",
    f"""SELECT tr, n, round(sum(value), 2) AS total FROM ({_resampled('min(size) OVER (PARTITION BY tr)', 3)}) GROUP BY tr, n
    HAVING count(*) = (SELECT count(DISTINCT file_idx) FROM samples)""",
    2,
)
def _(d):
    a = samples.condition_align(d.series, seed=3)
    return a.select("tr", "n", F.aggregate("reps", F.lit(0.0), lambda x, r: x + r["value"]).alias("total"))


# ---- variances


@query("variance_sample", "SELECT tr, round(avg(ln(value)),6) AS mean, round(var_pop(ln(value)),6) AS var FROM samples WHERE file_idx=0 GROUP BY tr")
def _(d):
    return samples.variance_sample(d.series.filter("file_idx = 0"))


@query("variance_sample_all", "SELECT tr, round(avg(ln(value)),6) AS mean, round(var_pop(ln(value)),6) AS var FROM samples GROUP BY tr")
def _(d):
    return samples.variance_sample(d.series)


@query(
    "variance_sqdif",
    """WITH s AS (SELECT tr, row_number() OVER (PARTITION BY tr ORDER BY n) - 1 AS i, ln(value) AS x, count(*) OVER (PARTITION BY tr) AS c FROM samples WHERE file_idx=0)
    SELECT a.tr, round(sum(a.x+b.x)/max(a.c),6) AS mean, round(sum((a.x-b.x)*(a.x-b.x))/max(a.c),6) AS var FROM s a JOIN s b ON a.tr=b.tr AND b.i=a.i+a.c//2 WHERE a.i < a.c//2 GROUP BY a.tr""",
)
def _(d):
    return samples.variance_sqdif(merged_single(d).filter("file_idx = 0"))


# ---- genes


@query("gene_info", """SELECT CAST(dense_rank() OVER (ORDER BY f)-1 AS BIGINT) AS gene_idx, gene, transcripts, round(avg_length,6) AS avg_length FROM (
    SELECT gene, min(tid) AS f, count(*) AS transcripts, avg(length) AS avg_length FROM trs GROUP BY gene)""")
def _(d):
    return genes.gene_info(d.trs)


@query("gene_expression", "SELECT file_idx, gene, n, round(sum(value),2) AS value FROM samples JOIN trs ON tid=tr GROUP BY 1,2,3", 2)
def _(d):
    return genes.gene_expression(d.series, d.trs)


_ADJUSTED = """SELECT file_idx, gene, n, value/sum(value) OVER (PARTITION BY file_idx, n) AS v FROM (
    SELECT file_idx, gene, n, sum(value/length) AS value FROM samples JOIN trs ON tid=tr GROUP BY 1,2,3)"""


@query("gene_expression_adjusted", f"SELECT file_idx, gene, n, round(v,8) AS value FROM ({_ADJUSTED})", 8)
def _(d):
    return genes.gene_expression(d.series, d.trs, adjust=True)


@query("gene_expression_rpkm", f"SELECT file_idx, gene, n, round(v*1e10::DOUBLE,1) AS value FROM ({_ADJUSTED})", 1)
def _(d):
    return genes.gene_expression(d.series, d.trs, rpkm=True)


@query("gene_expression_log", f"SELECT file_idx, gene, n, round(ln(v),6) AS value FROM ({_ADJUSTED})")
def _(d):
    return genes.gene_expression(d.series, d.trs, adjust=True, log=True)


for _key, _part in (("within_gene", "value"), ("within_gene_adjusted", "value/length")):

    def _make(adjust=_key.endswith("adjusted")):
        return lambda d: genes.within_gene(d.series, d.trs, adjust=adjust)

    query(_key, f"SELECT file_idx, gene, tr, n, round(({_part})/sum({_part}) OVER (PARTITION BY file_idx, gene, n), 8) AS value FROM samples JOIN trs ON tid=tr", 8)(_make())


@query("within_gene_log", "SELECT file_idx, gene, tr, n, round(ln(value)-ln(sum(value) OVER (PARTITION BY file_idx, gene, n)), 6) AS value FROM samples JOIN trs ON tid=tr")
def _(d):
    return genes.within_gene(d.series, d.trs, log=True)


@query(
    "within_gene_summary",
    """SELECT file_idx, tr, round(avg(a),8) AS mean, round(var_pop(a),8) AS var, round(avg(r),8) AS mean_within, round(var_pop(r),8) AS var_within FROM (
    SELECT file_idx, tr, x/sum(x) OVER (PARTITION BY file_idx, n) AS a, x/sum(x) OVER (PARTITION BY file_idx, gene, n) AS r FROM (
    SELECT file_idx, tr, n, gene, value/length AS x FROM samples JOIN trs ON tid=tr)) GROUP BY 1,2""",
    8,
)
def _(d):
    return genes.within_gene_summary(d.series, d.trs, adjust=True)


@query("update_genes_map", "SELECT tid, CASE WHEN s_acctbal > 0 THEN 'late' ELSE 'early' END || s_nationkey AS gene, s_name AS transcript, length FROM trs JOIN supplier ON tid = s_suppkey")
def _(d):
    s = d.table("supplier")
    first = s.select(F.concat(F.lit("early"), "s_nationkey").alias("gene"), F.col("s_name").alias("transcript"), F.col("s_suppkey").alias("line"))
    later = s.filter("s_acctbal > 0").select(F.concat(F.lit("late"), "s_nationkey").alias("gene"), F.col("s_name").alias("transcript"), (F.col("s_suppkey") + 10**9).alias("line"))
    return genes.update_genes_map(d.trs, first.unionByName(later)).select("tid", "gene", "transcript", "length")


@query("update_genes_list", "SELECT tid, 'g' || s_nationkey AS gene, transcript, length FROM trs JOIN supplier ON tid = s_suppkey")
def _(d):
    listed = d.table("supplier").select(F.col("s_suppkey").alias("tid"), F.concat(F.lit("g"), "s_nationkey").alias("gene"))
    return genes.update_genes_list(d.trs, listed).select("tid", "gene", "transcript", "length")


@query("check_gene_count", "SELECT count(*) AS transcripts, count(DISTINCT gene) AS genes, count(DISTINCT gene) <> 1 AND count(DISTINCT gene) <> count(*) AS ok FROM trs")
def _(d):
    return genes.check_gene_count(d.trs)


@query(
    "check_tr_grouping",
    "SELECT gene, count(*) AS transcripts, CAST(sum(CASE WHEN prev IS NULL OR prev <> gene THEN 1 ELSE 0 END) AS BIGINT) AS islands FROM (SELECT gene, lag(gene) OVER (ORDER BY tid) AS prev FROM trs) GROUP BY gene",
)
def _(d):
    return genes.check_tr_grouping(d.trs)


# ---- contrasts

_PAIR = "SELECT a.tr, a.n, ln(a.value) AS a, ln(b.value) AS b FROM samples a JOIN samples b ON a.tr=b.tr AND a.n=b.n AND a.file_idx=0 AND b.file_idx=3"


def ci_sql(rows: str, keys: str, value: str, cf: float = 95.0) -> str:
    """Order statistics of an interval, ranked by a window."""
    tail = f"{(100 - cf) / 2}::DOUBLE"
    return f"""SELECT {keys}, max(CASE WHEN i = CAST(floor(c/100::DOUBLE*{tail}) AS BIGINT) THEN x END) AS ci_low,
        max(CASE WHEN i = least(CAST(floor(c-c/100::DOUBLE*{tail}) AS BIGINT), c-1) THEN x END) AS ci_high FROM (
        SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS c FROM ({rows})) GROUP BY {keys}"""


@query(
    "pplr",
    f"""SELECT tr, round(pplr,6) AS pplr, round(log2fc,6) AS log2fc, round(ci_low,6) AS ci_low, round(ci_high,6) AS ci_high, round(mean_a,6) AS mean_a, round(mean_b,6) AS mean_b FROM (
    SELECT tr, avg(CASE WHEN b > a THEN 1::DOUBLE ELSE 0 END) AS pplr, avg((b-a)/{LN2}) AS log2fc, avg(a) AS mean_a, avg(b) AS mean_b FROM ({_PAIR}) GROUP BY tr)
    JOIN ({ci_sql(f'SELECT tr, (b-a)/{LN2} AS d FROM ({_PAIR})', 'tr', 'd')}) USING (tr)""",
)
def _(d):
    return contrasts.pplr(d.series, first=0, second=3)


@query("log_ratio_distribution", f"SELECT tr, n, round((b-a)/{LN2},6) AS log_ratio FROM ({_PAIR})")
def _(d):
    return contrasts.log_ratio_distribution(d.series, first=0, second=3)


@query(
    "fold_change",
    f"""SELECT tr, n, round((b-a)/{LN2},6) AS log2fc FROM (SELECT tr, n, avg(CASE WHEN cond=0 THEN ln(value) END) AS a, avg(CASE WHEN cond=1 THEN ln(value) END) AS b FROM samples GROUP BY 1,2)
    WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def _(d):
    return contrasts.fold_change(d.samples)


@query("credible_interval", f"SELECT file_idx, tr, ci_low, ci_high FROM ({ci_sql('SELECT file_idx, tr, value FROM samples', 'file_idx, tr', 'value', 90.0)})")
def _(d):
    return credible_interval(d.series, ["file_idx", "tr"], "value", 90.0)


# ---- chains


_MOMENTS = """SELECT tr, chain, count(*) AS draws, avg(theta) AS mean, var_samp(theta) AS var, avg(ln(theta)-ln(1-theta)) AS ml, var_samp(ln(theta)-ln(1-theta)) AS vl FROM chains GROUP BY 1,2"""
_RHAT = f"""SELECT tr, CASE WHEN w=0 THEN 0 ELSE sqrt((n-1)/n+bl/wl) END AS rhat, CASE WHEN w=0 THEN 0 ELSE sqrt((n-1)/n+b/w) END AS rhat_theta, mean_theta, wl AS within_logit, bl AS between_logit, n AS draws FROM (
    SELECT tr, avg(draws) AS n, avg(mean) AS mean_theta, avg(var) AS w, var_samp(mean) AS b, avg(vl) AS wl, var_samp(ml) AS bl FROM ({_MOMENTS}) GROUP BY tr)"""
_RHAT_ROUND = "tr, round(rhat,6) AS rhat, round(rhat_theta,6) AS rhat_theta, round(mean_theta,8) AS mean_theta, round(within_logit,6) AS within_logit, round(between_logit,6) AS between_logit, round(draws,6) AS draws"


def _rhat(d):
    return convergence.rhat(convergence.chain_moments(d.chains))


def _rhat_round(r):
    return r.withColumns({c: F.round(c, 8 if c == "mean_theta" else 6) for c in r.columns if c != "tr"})


@query("rhat", f"SELECT {_RHAT_ROUND} FROM ({_RHAT})", None)
def _(d):
    return _rhat_round(_rhat(d))


@query("rhat_worst", f"SELECT {_RHAT_ROUND} FROM (SELECT * FROM ({_RHAT}) ORDER BY rhat DESC, tr LIMIT 10)", None)
def _(d):
    return _rhat_round(convergence.rhat_worst(_rhat(d)))


@query("rhat_unconverged", f"SELECT {_RHAT_ROUND} FROM ({_RHAT}) WHERE rhat > 1.01", None)
def _(d):
    return _rhat_round(convergence.rhat_unconverged(_rhat(d), 1.01))


_NEED = f"SELECT tr, 50*draws/((draws-1)/draws*within_logit/between_logit+1) AS needed FROM ({_RHAT})"


@query(
    "effective_samples",
    f"""SELECT m, round(needed_95,6) AS needed_95, greatest(CAST(floor(needed_95) AS BIGINT), 50) AS next_samples FROM (
    SELECT max(c) AS m, max(CASE WHEN i = least(CAST(floor((c+1)*0.95::DOUBLE) AS BIGINT), c-1) THEN needed END) AS needed_95 FROM (
    SELECT needed, row_number() OVER (ORDER BY needed)-1 AS i, count(*) OVER () AS c FROM ({_NEED})))""",
)
def _(d):
    return convergence.effective_samples(_rhat(d), 50)


@query(
    "theta_means",
    f"""SELECT a.tr, round(mean_theta,8) AS mean_theta, CAST(floor(mean_theta*1000000+0.5::DOUBLE) AS BIGINT) AS mean_count, round(mean_logit_theta,6) AS mean_logit_theta, round(var_theta,8) AS var_theta,
    first_chain, chains FROM (SELECT tr, avg(theta) AS mean_theta, var_samp(theta) AS var_theta FROM chains GROUP BY tr) a
    JOIN (SELECT tr, avg(ml) AS mean_logit_theta, round(arg_min(mean, chain),8) AS first_chain, count(*) AS chains FROM ({_MOMENTS}) GROUP BY tr) b ON a.tr=b.tr""",
    None,
)
def _(d):
    t = convergence.theta_means(d.chains, 1_000_000)
    return t.select(
        "tr", F.round("mean_theta", 8).alias("mean_theta"), "mean_count", F.round("mean_logit_theta", 6).alias("mean_logit_theta"), F.round("var_theta", 8).alias("var_theta"),
        F.round(F.col("chain_means")[0], 8).alias("first_chain"), F.size("chain_means").cast("long").alias("chains"),
    )


@query(
    "thinning",
    """SELECT file_idx, tr, n, value FROM samples WHERE n+1 <= 84 AND least(30, n+1, greatest(CAST(floor((n+1)*(30::DOUBLE/84)) AS BIGINT), 30-84+n+2)) >
    CASE WHEN n > 0 THEN greatest(0, least(30, n, greatest(CAST(floor(n*(30::DOUBLE/84)) AS BIGINT), 30-84+n+1))) ELSE 0 END""",
)
def _(d):
    return convergence.thinning(d.series.withColumn("i", F.col("n") + 1), 84, 30).drop("i")


# ---- hyperparameters and differential expression


@query("params_distinct", "SELECT round(expr,6) AS expr, round(min(a),6) AS alpha, round(arg_min(b,a),6) AS beta FROM (SELECT round(expr,1) AS expr, alpha AS a, beta AS b FROM curve) GROUP BY expr")
def _(d):
    return smoothing.params_distinct(d.curve.withColumn("expr", F.round("expr", 1)))


_MU = "SELECT tr, cond, avg(ln(value)) AS mu_c FROM samples GROUP BY 1,2"
_PRIOR = f"""SELECT tr, cond, mu_c, mu00, arg_min(alpha, row(abs(expr-mu_c), -expr)) AS alpha, arg_min(beta, row(abs(expr-mu_c), -expr)) AS beta FROM (
    SELECT tr, cond, mu_c, avg(mu_c) OVER (PARTITION BY tr) AS mu00 FROM ({_MU})) CROSS JOIN curve GROUP BY 1,2,3,4"""


@query("nearest_params", f"SELECT tr, cond, round(mu_c,6) AS mu_c, round(alpha,6) AS alpha, round(beta,6) AS beta FROM ({_PRIOR})")
def _(d):
    mu = de.log_samples(d.samples).groupBy("tr", "cond").agg(F.avg("value").alias("mu_c"))
    return de.nearest_params(mu, d.curve, "mu_c")


@query("de_prior", f"SELECT tr, cond, round(mu_c,6) AS mu_c, round(mu00,6) AS mu00, round(alpha,6) AS alpha, round(beta,6) AS beta FROM ({_PRIOR})")
def _(d):
    return de.de_prior(d.samples, d.curve)


_POSTERIOR = f"""SELECT tr, cond, n, (2*mu00+s)/(2+r) AS post_mean, alpha+r/2::DOUBLE AS post_alpha, beta+0.5::DOUBLE*(2*mu00*mu00+ss-(2*mu00+s)*(2*mu00+s)/(2+r)) AS post_beta, r AS reps FROM (
    SELECT tr, cond, n, count(*) AS r, sum(ln(value)) AS s, sum(ln(value)*ln(value)) AS ss FROM samples GROUP BY 1,2,3) JOIN ({_PRIOR}) USING (tr, cond)"""


@query("de_posterior", f"SELECT tr, cond, n, round(post_mean,6) AS post_mean, round(post_alpha,6) AS post_alpha, round(post_beta,6) AS post_beta, reps FROM ({_POSTERIOR})")
def _(d):
    return de.de_posterior(d.samples, de.de_prior(d.samples, d.curve))


_DRAWN = f"""SELECT tr, cond, n, post_mean + sqrt(var) * {normal_sql(12, 'tr', 'cond', 'n')} AS value, var FROM (
    SELECT *, 1 / (g / post_beta * (2 + reps)) AS var FROM ({gamma_sql(_POSTERIOR, 'tr, cond, n', 11, 'post_alpha')}))"""


@query("de_samples", f"SELECT tr, cond, n, round(value,6) AS value, round(var,6) AS var FROM ({_DRAWN})")
def _(d):
    return de.de_samples(de.de_posterior(d.samples, de.de_prior(d.samples, d.curve)), seed=11)


# Replicate means stand in for posterior draws where the result has to be exact.
_DRAWS = "SELECT tr, cond, n, avg(ln(value)) AS value FROM samples GROUP BY 1,2,3"
_PAIRS = f"SELECT a.tr, a.n, a.cond AS cond_a, b.cond AS cond_b, b.value-a.value AS d FROM ({_DRAWS}) a JOIN ({_DRAWS}) b ON a.tr=b.tr AND a.n=b.n AND a.cond<b.cond"


def _draws(d):
    return de.log_samples(d.samples).groupBy("tr", "cond", "n").agg(F.avg("value").alias("value"))


@query("de_pplr", f"SELECT tr, cond_a, cond_b, round(avg(CASE WHEN d>0 THEN 1::DOUBLE ELSE 0 END),6) AS pplr FROM ({_PAIRS}) GROUP BY 1,2,3")
def _(d):
    return de.de_pplr(_draws(d))


def _fold_change(pairs: str) -> str:
    return f"""SELECT tr, cond_a, cond_b, round(log2fc,6) AS log2fc, round(ci_low,6) AS ci_low, round(ci_high,6) AS ci_high FROM (SELECT tr, cond_a, cond_b, avg(d/{LN2}) AS log2fc FROM ({pairs}) GROUP BY 1,2,3)
    JOIN ({ci_sql(f'SELECT tr, cond_a, cond_b, d/{LN2} AS d FROM ({pairs})', 'tr, cond_a, cond_b', 'd')}) USING (tr, cond_a, cond_b)"""


@query("de_fold_change", _fold_change(_PAIRS))
def _(d):
    return de.de_fold_change(_draws(d))


@query(
    "estimate_de",
    f"""WITH drawn AS MATERIALIZED ({_DRAWN}), apart AS (
        SELECT a.tr, a.n, a.cond AS cond_a, b.cond AS cond_b, b.value-a.value AS d FROM drawn a JOIN drawn b ON a.tr=b.tr AND a.n=b.n AND a.cond<b.cond)
    SELECT * FROM (SELECT tr, cond_a, cond_b, round(avg(CASE WHEN d>0 THEN 1::DOUBLE ELSE 0 END),6) AS pplr FROM apart GROUP BY 1,2,3) JOIN ({_fold_change('SELECT * FROM apart')}) USING (tr, cond_a, cond_b)""",
)
def _(d):
    """Prior, posterior, draws and report in one go."""
    drawn = cut_lineage(de.de_samples(de.de_posterior(d.samples, de.de_prior(d.samples, d.curve)), seed=11))
    return de.de_pplr(drawn).join(de.de_fold_change(drawn), ["tr", "cond_a", "cond_b"])


_MEANS = "SELECT tr, avg(ln(value)) AS mean FROM samples GROUP BY tr"


def _means(d):
    return samples.variance_sample(d.series).select("tr", "mean")


@query(
    "hyper_badd",
    f"""SELECT tr, cond, n, round(0.5::DOUBLE*(ss+mean*mean*2-(s+mean*2)*(s+mean*2)/(2+r)),6) AS badd, r AS reps FROM (
    SELECT tr, cond, n, count(*) AS r, sum(ln(value)) AS s, sum(ln(value)*ln(value)) AS ss FROM samples GROUP BY 1,2,3) JOIN ({_MEANS}) USING (tr)""",
)
def _(d):
    return hyper.hyper_badd(d.samples, _means(d))


@query("expression_sorted", "SELECT tr, round(mean,6) AS expr, rank() OVER (ORDER BY mean DESC, tr) - 1 AS rank FROM (SELECT tr, avg(ln(value)) AS mean FROM samples GROUP BY tr)")
def _(d):
    from readweave.functions.ranking import global_rank

    return global_rank(_means(d), "mean", "tr", "rank", descending=True).select("tr", F.col("mean").alias("expr"), "rank")


def groups_sql(kept: str, every: str) -> str:
    """SQL of the groups of 20 steps: a row-by-row walk down the expressions."""
    return f"""WITH RECURSIVE m AS (SELECT tr, mean, row_number() OVER (ORDER BY mean DESC, tr) AS r FROM ({kept})),
    lim AS (SELECT (max(mean)-min(mean))/20 AS delta, max(mean) AS top FROM ({every})),
    walk AS (SELECT r, tr, mean, CAST(0 AS BIGINT) AS grp, 1 AS members, (SELECT top FROM lim) AS last_end FROM m WHERE r=1
      UNION ALL SELECT m.r, m.tr, m.mean, CASE WHEN c THEN w.grp+1 ELSE w.grp END, CASE WHEN c THEN 1 ELSE w.members+1 END, CASE WHEN c THEN w.mean ELSE w.last_end END
      FROM (SELECT *, (members >= 10 AND (SELECT delta FROM lim) < last_end-mean) OR members = 5000 AS c FROM walk) w JOIN m ON m.r = w.r+1)
    SELECT tr, round(mean,6) AS mean, grp FROM walk WHERE grp IN (SELECT grp FROM walk GROUP BY grp HAVING count(*) >= 10)"""


@query("hyper_groups", groups_sql(_MEANS, _MEANS))
def _(d):
    return hyper.hyper_groups(_means(d), groups=20)


@query("hyper_sample")
def _(d):
    grouped = hyper.hyper_groups(_means(d), groups=8)
    return hyper.hyper_sample(hyper.hyper_badd(d.samples, _means(d)), grouped, samples_n=1, seed=3, batch=100, max_batches=150)


def _bell(share: str, power: int) -> str:
    return f"CASE WHEN {share} <= 0.001 THEN 1 WHEN {share} <= 0.999 THEN pow(1-pow({share},{power}),{power}) ELSE 0 END"


def _lowess_sql(y: str, steps: int = 5) -> str:
    """CTEs of robust local regression of ``y`` on the curve; the last one, ``y_fit``, has pos and fit."""
    ctes = [f"{y}_t0 AS (SELECT i, 1::DOUBLE AS t FROM c)"]
    for p in range(steps + 1):
        ctes += [
            f"{y}_s{p} AS (SELECT pos, sum(w*t) AS sw, sum(w*t*x)/sum(w*t) AS mx, sum(w*t*{y})/sum(w*t) AS my FROM k JOIN {y}_t{p} USING (i) JOIN c USING (i, x) GROUP BY pos)",
            f"{y}_v{p} AS (SELECT pos, any_value(mx) AS mx, any_value(my) AS my, sum(w*t*(x-mx)*(x-mx))/any_value(sw) AS var, sum(w*t*(x-mx)*{y})/any_value(sw) AS cov FROM k JOIN {y}_t{p} USING (i) JOIN c USING (i, x) JOIN {y}_s{p} USING (pos) GROUP BY pos)",
            f"{y}_f{p} AS (SELECT pos, my + CASE WHEN sqrt(var) > 0.001*(SELECT span FROM size) THEN cov/var*(pos-mx) ELSE 0 END AS fit FROM {y}_v{p})",
        ]
        if p < steps:
            ctes += [
                f"{y}_r{p} AS (SELECT i, abs({y}-fit) AS r, 6*median(abs({y}-fit)) OVER () AS top FROM c JOIN {y}_f{p} ON pos = x)",
                f"{y}_t{p + 1} AS (SELECT i, {_bell('(r/top)', 2)}::DOUBLE AS t FROM {y}_r{p})",
            ]
    return ", ".join([*ctes, f"{y}_fit AS (SELECT pos, fit AS {y}_fit FROM {y}_f{steps})"])


@query(
    "hyper_smooth",
    f"""WITH c AS (SELECT row_number() OVER (ORDER BY expr, alpha, beta) AS i, expr AS x, alpha, beta FROM curve),
    size AS (SELECT greatest(2, floor(0.2*count(*)))::INT AS near, max(x)-min(x) AS span FROM c),
    g AS (SELECT pos, i, x, abs(x-pos) AS gap, list_sort(list(abs(x-pos)) OVER (PARTITION BY pos))[(SELECT near FROM size)] AS h FROM (SELECT DISTINCT x AS pos FROM c), c),
    k AS (SELECT pos, i, x, {_bell('(gap/h)', 3)} AS w FROM g), {_lowess_sql('alpha')}, {_lowess_sql('beta')}
    SELECT round(pos, 6) AS expr, round(alpha_fit, 6) AS alpha, round(beta_fit, 6) AS beta FROM alpha_fit JOIN beta_fit USING (pos)""",
)
def _(d):
    return smoothing.smooth_params(d.curve)


@query("hyper_groups_above", groups_sql(f"SELECT * FROM ({_MEANS}) WHERE mean >= (SELECT avg(mean) FROM ({_MEANS}))", f"SELECT * FROM ({_MEANS})"))
def _(d):
    """Groups of the transcripts above an expression threshold; the step still spans all of them."""
    means = _means(d)
    return hyper.hyper_groups(means, groups=20, ex_t=means.agg(F.avg("mean")).first()[0])


@query("rename_transcripts", "SELECT tid, gene, 'iso-'||tid AS transcript, length, eff_length FROM trs", None)
def _(d):
    names = d.table("supplier").select(F.col("s_suppkey").alias("tid"), F.concat(F.lit("iso-"), "s_suppkey").alias("name"))
    return genes.rename_transcripts(d.trs, names)


@query("all_transcripts", f"SELECT tid AS tr, mean, var FROM parts LEFT JOIN ({ORACLE['variance_sample_all']}) v ON v.tr = tid")
def _(d):
    return samples.all_transcripts(samples.variance_sample(d.series), d.parts)


@query("genes_per_reference", "SELECT count(DISTINCT gene) AS genes FROM trs", None)
def _(d):
    return annotation.genes_per_reference(d.trs)

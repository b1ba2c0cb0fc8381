"""Registered queries over alignments, sequences and gene models, with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.functions import dna, numeric
from readweave.functions.dna import REVERSE, flag_set
from readweave.functions.text import gtf_attribute
from readweave.operators import annotation, bias, fragments, genes, hits, legacy, scoring
from readweave.plans.domain import PLACES, Domain, with_views
from readweave.plans.sample_queries import rounded
from readweave.session import cut_lineage, scratch_path, shuffles_dropped
from readweave.sources import alignments as aln
from readweave.sources import sequence, tables, writers

QUERIES = {}
ORACLE = {}


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


# ---- sparse hits


@query("dedupe_alignments", "SELECT read_id, tr_id, round(lprob,6) AS lprob FROM merged")
def _(d):
    return hits.dedupe_alignments(d.hits)


@query("normalise_alignments", "SELECT read_id, tr_id, round(prob,8) AS prob FROM probs", 8)
def _(d):
    return hits.normalise_alignments(d.hits)


@query("alignment_totals", "SELECT max(tr_id)+1 AS m, count(DISTINCT read_id) AS n_reads, count(*) AS n_hits FROM merged")
def _(d):
    return hits.alignment_totals(d.hits)


@query("sparse_softmax", "SELECT read_id, tr_id, round(prob,8) AS phi, round(ln(prob),6) AS log_phi FROM probs", None)
def _(d):
    m = hits.row_softmax(hits.dedupe_alignments(d.hits), "lprob", "phi", "log_phi")
    return m.select("read_id", "tr_id", F.round("phi", 8).alias("phi"), F.round("log_phi", 6).alias("log_phi"))


@query("sparse_sum_rows", "SELECT read_id, round(sum(exp(lprob)),8) AS total FROM merged GROUP BY read_id", 8)
def _(d):
    return hits.sum_rows(hits.dedupe_alignments(d.hits).withColumn("p", F.exp("lprob")), "p")


@query("sparse_sum_cols", "SELECT tr_id, round(sum(prob),6) AS total FROM probs GROUP BY tr_id")
def _(d):
    return hits.sum_cols(hits.normalise_alignments(d.hits), "prob")


@query("count_above_delta", "SELECT count(*) FILTER (prob > 0.99) AS above FROM probs")
def _(d):
    return hits.count_above_delta(hits.normalise_alignments(d.hits), "prob")


@query("limit_alignments", "SELECT read_id, tr_id, lprob FROM raw_hits WHERE read_id IN (SELECT read_id FROM raw_hits GROUP BY 1 HAVING count(*) <= 4)")
def _(d):
    return hits.limit_alignments(d.raw_hits, 4)


# ---- scalar functions


@query("log_add_exp", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(exp(-l_quantity/5::DOUBLE)+exp(-l_tax*100)),6) AS v FROM lineitem")
def _(d):
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric.log_add_exp(-F.col("l_quantity") / 5.0, -F.col("l_tax") * 100).alias("v"))


@query("log_sum_exp", "SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))),6) AS v FROM embeddings")
def _(d):
    return d.table("embeddings").select("vec_id", numeric.log_sum_exp(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))


@query("logit", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity/60::DOUBLE)-ln(1-l_quantity/60::DOUBLE),6) AS v FROM lineitem")
def _(d):
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric.logit(F.col("l_quantity") / 60.0).alias("v"))


# The comparison engine has no digamma: recurrence to x + 20, then the series there.
def _digamma_sql(x: str) -> str:
    z = f"({x}+20::DOUBLE)"
    terms = "+".join(f"1/({x}+{k})" for k in range(20))
    return f"(ln({z})-1/(2*{z})-1/(12*{z}*{z})+1/(120*pow({z},4))-1/(252*pow({z},6))-({terms}))"


@query("digamma", f"SELECT o_orderkey, round({_digamma_sql('x')},6) AS v FROM (SELECT o_orderkey, o_totalprice/1000 AS x FROM orders WHERE o_totalprice > 0)")
def _(d):
    return d.table("orders").filter("o_totalprice > 0").select("o_orderkey", numeric.digamma(F.col("o_totalprice") / 1000).alias("v"))


@query("lgamma", "SELECT o_orderkey, round(lgamma(o_totalprice/1000),6) AS v FROM orders WHERE o_totalprice > 0")
def _(d):
    return d.table("orders").filter("o_totalprice > 0").select("o_orderkey", numeric.lgamma(F.col("o_totalprice") / 1000).alias("v"))


@query("length_logpdf", "SELECT doc_id, CASE WHEN length(text)=0 THEN -100 ELSE round(-(ln(length(text))+ln(0.5::DOUBLE)+0.918938533192::DOUBLE+pow((ln(length(text))-5)/0.5::DOUBLE,2)/2),6) END AS v FROM documents")
def _(d):
    return d.table("documents").select("doc_id", numeric.lognormal_logpdf(F.length("text"), F.lit(5.0), F.lit(0.5)).alias("v"))


@query("phred_logprob", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1-pow(10,-l_quantity/10)),6) AS log_right, round(-l_quantity/10*ln(10),6) AS log_wrong FROM lineitem WHERE l_quantity > 0")
def _(d):
    right, wrong = numeric.phred_log_prob(F.col("l_quantity"))
    return d.table("lineitem").filter("l_quantity > 0").select("l_orderkey", "l_linenumber", "l_partkey", right.alias("log_right"), wrong.alias("log_wrong"))


@query("reverse_complement", "SELECT tid, reverse(translate(seq,'ACGT','TGCA')) AS seq FROM seqs", None)
def _(d):
    return d.seqs.select("tid", dna.reverse_complement(F.col("seq")).alias("seq"))


@query(
    "padded_slice",
    """SELECT tid, substring(repeat('N',40)||seq||repeat('N',2*length(seq)+90), 11, length(seq)+80) AS around, substring(repeat('N',40)||seq||repeat('N',2*length(seq)+90), 41+length(seq)//2, length(seq)) AS tail FROM seqs""",
    None,
)
def _(d):
    n = F.length("seq")
    return d.seqs.select("tid", dna.padded_slice(F.col("seq"), F.lit(-30), n + 80).alias("around"), dna.padded_slice(F.col("seq"), F.floor(n / 2).cast("int"), n).alias("tail"))


_CIGARS = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS a, (l_tax*100)::INT AS i, (l_discount*100)::INT AS dl FROM lineitem"""


def _cigars(d):
    n = F.col("l_quantity").cast("int").cast("string")
    i = F.round(F.col("l_tax") * 100).cast("int").cast("string")
    dl = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    return d.table("lineitem").withColumn("cigar", F.concat(n, F.lit("M"), i, F.lit("I"), F.lit("7="), dl, F.lit("D"), n, F.lit("X3S")))


@query("cigar_end", f"SELECT l_orderkey, l_linenumber, l_partkey, l_partkey + 2*a + 7 + dl AS v FROM ({_CIGARS})")
def _(d):
    return _cigars(d).select("l_orderkey", "l_linenumber", "l_partkey", dna.cigar_end(F.col("l_partkey"), F.col("cigar")).alias("v"))


@query("cigar_del_minus_ins", f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(dl - i AS BIGINT) AS v FROM ({_CIGARS})")
def _(d):
    return _cigars(d).select("l_orderkey", "l_linenumber", "l_partkey", dna.cigar_del_minus_ins(F.col("cigar")).cast("long").alias("v"))


@query("gtf_attribute", "SELECT event_id, 'g'||user_id||'_'||event_type AS gene_id, event_type AS gene_name, '' AS havana_gene FROM events")
def _(d):
    a = F.col("attribute")
    whole = gtf_attribute(a, "transcript_id")
    x = d.exons.withColumn("event_id", F.substring(whole, F.lit(2), F.length(whole)).cast("long"))
    return x.select("event_id", *[gtf_attribute(a, n).alias(n) for n in ("gene_id", "gene_name", "havana_gene")])


# ---- readers: text written from the tables by Spark, then read back


@query("read_fasta", "SELECT tid, name, gene, seq FROM seqs", None)
def _(d):
    path = scratch_path(d.spark, "fasta")
    s = d.seqs.withColumn("seq", F.when(F.length("seq") == 0, F.lit("N")).otherwise(F.col("seq")))
    sequence.write_fasta(s, path, F.concat_ws(" ", "name", F.concat(F.lit("gene:"), "gene")))
    return sequence.read_fasta(d.spark, path)


@query("fasta_gene_standard", "SELECT doc_id AS tid, source AS gene FROM documents", None)
def _(d):
    records = d.seqs.select("tid", F.concat_ws(" ", "name", F.concat(F.lit("gene="), "gene"), F.lit("x")).alias("header"), "seq")
    return sequence.name_records(records).select("tid", "gene")


@query("fasta_gene_gencode", "SELECT doc_id AS tid, 'doc'||doc_id AS name, source AS gene FROM documents", None)
def _(d):
    records = d.seqs.select("tid", F.concat_ws("|", "name", "gene", F.lit("-"), F.lit("")).alias("header"), "seq")
    return sequence.name_records(records, "gencode").select("tid", "name", "gene")


@query("fasta_grep", "SELECT tid, name FROM seqs WHERE regexp_matches(gene, '^src1[0-9]$')", None)
def _(d):
    records = d.seqs.select("tid", F.concat_ws(" ", "name", "gene").alias("header"), "seq", "name")
    return annotation.fasta_grep(records, " src1[0-9]$").select("tid", "name")


@query("extract_transcript_info", "SELECT doc_id AS tid, source AS gene, 'doc'||doc_id AS transcript, length(text) AS length FROM documents", None)
def _(d):
    records = d.seqs.select("tid", F.concat_ws(" ", "name", F.lit("gene:old"), F.concat(F.lit("gene:"), "gene")).alias("header"), "seq")
    return annotation.extract_transcript_info(records, "ens").withColumn("length", F.col("length").cast("long"))


@query("read_tr", "SELECT dense_rank() OVER (ORDER BY tid) - 1 AS tid, gene, transcript, CAST(length AS INT) AS length, eff_length FROM parts")
def _(d):
    path = writers.write_tr(d.parts, scratch_path(d.spark, "tr"))
    return tables.read_tr(d.spark, path)


@query("read_prob", "SELECT CAST(read_id AS VARCHAR) AS read_id, dense_rank() OVER (ORDER BY read_id) - 1 AS read_idx, CAST(tr_id AS INT) AS tr_id, lprob FROM hits")
def _(d):
    path = scratch_path(d.spark, "prob")
    h = d.hits.select(F.col("read_id").cast("string").alias("read_id"), F.col("read_id").alias("read_idx"), "tr_id", "lprob")
    n = h.select("read_id").distinct().count()
    writers.write_prob(h, path, n, n, d.n_transcripts)
    return tables.read_prob(d.spark, path)


@query("read_samples", "SELECT 0 AS file_idx, dense_rank() OVER (ORDER BY tr) - 1 AS tr, dense_rank() OVER (PARTITION BY tr ORDER BY n) - 1 AS n, round(value*2,2) AS value FROM samples WHERE file_idx = 0", 2)
def _(d):
    path = scratch_path(d.spark, "samples")
    writers.write_samples(d.series.filter("file_idx = 0"), path)
    return tables.read_samples(d.spark, path, 0, norm=2.0)


@query("read_expression", "SELECT row_number() OVER (ORDER BY tr) - 1 AS tr, round(m,6) AS expr, round(v,6) AS var FROM (SELECT tr, avg(ln(value)) AS m, var_pop(ln(value)) AS v FROM samples GROUP BY tr)")
def _(d):
    from readweave.operators.samples import variance_sample

    path = scratch_path(d.spark, "joint") + ".mean"
    writers.write_mean_variance(variance_sample(d.series), path, logged=True)
    return tables.read_expression(d.spark, path)


@query("read_params", "SELECT round(expr,6) AS expr, round(alpha,6) AS alpha, round(beta,6) AS beta FROM curve")
def _(d):
    path = scratch_path(d.spark, "params")
    writers.write_params(d.curve, path, 2.0)
    return tables.read_params(d.spark, path)


@query("read_gtf", "SELECT * FROM exons", None)
def _(d):
    path = scratch_path(d.spark, "gtf")
    d.gtf_lines.write.option("compression", "gzip").text(path)
    return sequence.read_gtf(d.spark, path)


@query("read_tr_map", "SELECT p_brand AS gene, 'p'||p_partkey AS transcript, row_number() OVER (ORDER BY p_partkey) - 1 AS line FROM part")
def _(d):
    path = scratch_path(d.spark, "map")
    d.table("part").orderBy("p_partkey").select(F.concat_ws(" ", "p_brand", F.concat(F.lit("p"), "p_partkey"))).write.text(path)
    return tables.read_tr_map(d.spark, path)


@query("read_gene_list", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS tid, p_brand AS gene FROM part")
def _(d):
    path = scratch_path(d.spark, "genes")
    d.table("part").orderBy("p_partkey").select("p_brand").write.text(path)
    return tables.read_gene_list(d.spark, path)


class _InOrder(Domain):
    """The same tables, documents laid out by ranges of their number."""

    def table(self, name: str) -> DataFrame:
        out = super().table(name)
        # a fixed number of ranges, as a task makes many times as much text as it reads
        return out.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id") if name == "documents" else out


def sam_lines(d: Domain) -> DataFrame:
    """SAM text: @SQ lines in document order, then both mates of every fragment.

    Documents are laid out in order and lines sorted within their range, so lines, which are many times as large, aren't shuffled.
    """
    head = d.doc_trs.select(F.col("tid").alias("o1"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "transcript"), F.concat(F.lit("LN:"), "length")).alias("value"))

    def line(m: str, o2: int):
        c = F.col(m)
        fields = [c["qname"], c["flag"], F.concat(F.lit("doc"), c["tid"]), c["pos"] + 1, F.lit(255), c["cigar"], F.lit("*"), F.lit(0), F.lit(0), c["seq"], c["qual"]]
        return F.struct(F.lit(o2).alias("o2"), F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value"))

    both = F.when(F.col("paired"), F.array(line("first", 1), line("second", 2))).otherwise(F.array(line("first", 1)))
    body = _InOrder(d.spark, d.dir).frags.select(F.col("frag_seq").alias("o1"), F.explode(both).alias("l")).select("o1", "l.o2", "l.value")
    return head.orderBy("o1").select("value").unionByName(body.sortWithinPartitions("o1", "o2").select("value"))


def _sam_file(d: Domain) -> str:
    """The text, compressed: it has several times the bytes of the tables. Lines go to as many files as documents have ranges."""
    path = scratch_path(d.spark, "sam")
    with shuffles_dropped(d.spark):
        sam_lines(d).write.option("compression", "gzip").text(path)
    return path


_RECORDS = """SELECT read_id AS qname, CASE WHEN paired THEN 67 ELSE 0 END + CASE WHEN back THEN 16 ELSE 0 END AS flag, tid, p AS pos, rl, s1 AS seq, q1 AS qual FROM frags
    UNION ALL SELECT read_id, 131 + CASE WHEN back THEN 0 ELSE 16 END, tid, p2, rl, s2, q2 FROM frags WHERE paired"""


def _sam(d: Domain) -> DataFrame:
    return aln.read_sam(d.spark, _sam_file(d))


@query("read_sam", f"SELECT qname, CAST(flag AS INT) AS flag, 'doc'||tid AS rname, CAST(tid AS INT) AS tid, CAST(pos AS INT) AS pos, 255 AS mapq, rl||'M' AS cigar, seq, qual FROM ({_RECORDS})", None)
def _(d):
    return _sam(d).drop("file_seq")


@query("tr_from_sam_header", "SELECT dense_rank() OVER (ORDER BY tid) - 1 AS tid, 'none' AS gene, transcript, CAST(length AS INT) AS length, eff_length FROM doc_trs")
def _(d):
    return aln.tr_from_sam_header(d.spark, _sam_file(d))


# ---- gene models


@query(
    "reconstruct_genes",
    """SELECT seqname, gene_id, min(start) AS start, max("end") AS "end", arg_min(strand, row(start, "end", attribute)) AS strand, arg_min(attribute, row(start, "end", attribute)) AS attribute FROM exons GROUP BY 1,2""",
    None,
)
def _(d):
    return annotation.reconstruct_genes(d.exons).drop("source")


@query(
    "gene_sequences",
    """SELECT g.seqname, g.gene_id, g.start, g."end", g.strand, CASE WHEN strand='-' THEN reverse(translate(s,'ACGT','TGCA')) ELSE s END AS seq FROM (
    SELECT x.*, substring(q.seq, x.start, x."end"-x.start+1) AS s FROM (
    SELECT seqname, gene_id, min(start) AS start, max("end") AS "end", min(strand) AS strand, count(*) AS c FROM exons GROUP BY 1,2 HAVING count(*) <> 1) x JOIN seqs q ON x.seqname = 'chr'||q.tid) g""",
    None,
)
def _(d):
    models = annotation.gene_models(d.exons)
    return annotation.gene_sequences(models, d.exons, d.genome).drop("attribute")


@query("genome_slice", """SELECT DISTINCT seqname, start, "end", substring(seq, start, "end"-start+1) AS seq FROM exons JOIN seqs ON seqname = 'chr'||tid""", None)
def _(d):
    genome = d.genome.withColumn("chromosome", F.concat(F.lit("chr"), "chromosome"))
    return sequence.genome_slice(d.exons, genome, ["seqname", "start", "end"])


@query(
    "gene_fasta",
    """SELECT gene_id, 'g'||substring(gene_id,2)||' cdna:N/A chromosome:N/A:'||seqname||':'||start||':'||"end"||':'||CASE WHEN strand='+' THEN '1' ELSE '-1' END||' gene:'||gene_id||' gene_biotype:N/A transcript_biotype:N/A' AS header
    FROM (SELECT seqname, gene_id, min(start) AS start, max("end") AS "end", min(strand) AS strand FROM exons GROUP BY 1,2)""",
    None,
)
def _(d):
    g = annotation.reconstruct_genes(d.exons).withColumn("attribute", F.regexp_replace("attribute", "transcript_id [^;]*; ", ""))
    return g.select("gene_id", sequence.ensembl_header().alias("header"))


@query("check_lengths", "SELECT count(*) AS transcripts, count(*) AS compared, count(*) FILTER (doc_id % 2 = 0) AS mismatched FROM documents")
def _(d):
    off = d.doc_trs.withColumn("length", F.col("length") + F.when(F.col("tid") % 2 == 0, 1).otherwise(0))
    return genes.check_lengths(off, d.seqs)


# ---- fragments and reads


@query(
    "pair_fragments",
    "SELECT read_id AS qname, paired, CAST(p AS INT) AS pos, CASE WHEN paired THEN CAST(p2 AS INT) ELSE -1 END AS pos2, count(*) AS n FROM frags GROUP BY ALL",
    None,
)
def _(d):
    f = fragments.pair_fragments(_sam(d))
    return f.groupBy(F.col("first.qname").alias("qname"), "paired", F.col("first.pos").alias("pos"), F.coalesce("second.pos", F.lit(-1)).alias("pos2")).agg(F.count(F.lit(1)).alias("n"))


@query("group_reads", "SELECT qname||'/*' AS read_id, count(*) AS n FROM (SELECT read_id AS qname FROM frags) GROUP BY 1", None)
def _(d):
    f = d.frags.withColumn("first", F.col("first").withField("qname", F.concat(F.col("first.qname"), F.lit("/"), (F.col("frag_seq") % 3).cast("string"))))
    return fragments.group_reads(f).groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_counts",
    """SELECT count(*) AS n_total, count(*) FILTER (c <= 5) AS n_map, 0::BIGINT AS no_end_info, count(*) FILTER (p > 0 AND s > 0) AS mixed_ends, CAST(sum(p) AS BIGINT) AS paired_n,
    0::BIGINT AS first_n, 0::BIGINT AS second_n, CAST(sum(s) AS BIGINT) AS single_n, 0::BIGINT AS weird_n, 0::BIGINT AS bad_n FROM (
    SELECT read_id, count(*) AS c, count(*) FILTER (paired) AS p, count(*) FILTER (NOT paired) AS s FROM frags GROUP BY read_id)""",
)
def _(d):
    return fragments.read_counts(fragments.read_summary(d.frags), limit=5)


def _half_mapped(d: Domain) -> DataFrame:
    """Fragments whose unpaired ones are marked as one mapped half of a pair."""
    half = F.when(F.col("paired"), F.col("first.flag")).otherwise(F.lit(1 + 8 + 64))
    return d.frags.withColumn("first", F.col("first").withField("flag", half))


@query("exclude_singletons", "SELECT tid, p AS pos FROM frags WHERE read_id IN (SELECT read_id FROM frags WHERE paired)", None)
def _(d):
    f = _half_mapped(d)
    kept = fragments.exclude_singletons(f, fragments.read_summary(f))
    return kept.select(F.col("first.tid").cast("long").alias("tid"), F.col("first.pos").cast("long").alias("pos"))


@query(
    "flag_stats",
    f"""SELECT count(*) AS n, count(*) FILTER (flag & 1 <> 0) AS n_paired, count(*) FILTER (flag & 2 <> 0) AS n_proper, count(*) FILTER (flag & 4 <> 0) AS n_unmapped, count(*) FILTER (flag & 8 <> 0) AS n_mate_unmapped,
    count(*) FILTER (flag & 16 <> 0) AS n_reverse, count(*) FILTER (flag & 64 <> 0) AS n_read1, count(*) FILTER (flag & 128 <> 0) AS n_read2 FROM ({_RECORDS})""",
)
def _(d):
    one = F.when(F.col("paired"), F.array("first.flag", "second.flag")).otherwise(F.array("first.flag"))
    return fragments.flag_stats(d.frags.select(F.explode(one).alias("flag")))


@query(
    "alignment_diagnostics",
    """SELECT count(*) AS fragments, count(*) FILTER (tid >= 150) AS unknown_tid, 0::BIGINT AS tid_mismatch, count(*) FILTER (tid < 150 AND paired AND back) AS wrong_strand,
    count(*) FILTER (tid < 150 AND paired AND p > p2) AS first_mate_down FROM frags""",
)
def _(d):
    return fragments.alignment_diagnostics(d.frags, 150)


def _unique(d: Domain) -> DataFrame:
    return fragments.unique_places(d.frags, 2**31 - 1)


@query("observe_unique", "SELECT tid, CAST(p AS BIGINT) AS pos, frag_len FROM uniq", None)
def _(d):
    unique = fragments.observe_unique(d.frags, fragments.read_summary(d.frags), 2**31 - 1)
    return unique.select(F.col("first.tid").cast("long").alias("tid"), F.col("first.pos").cast("long").alias("pos"), "frag_len")


@query("frag_length_hist", "SELECT frag_len, count(*) AS fragments FROM uniq WHERE paired GROUP BY 1")
def _(d):
    return scoring.frag_length_hist(_unique(d))


_FIT = "SELECT count(*) AS pairs, avg(ln(frag_len)) AS mu, stddev_pop(ln(frag_len)) AS sigma FROM uniq WHERE paired"


@query("frag_length_fit", f"SELECT pairs, round(mu,6) AS mu, round(sigma,6) AS sigma, pairs > 10 AS valid FROM ({_FIT})")
def _(d):
    return scoring.frag_length_fit(_unique(d))


# A fixed length model keeps the later queries independent of the fit.
FIT = (4.35, 0.2)
_MU, _SD = "4.35::DOUBLE", "0.2::DOUBLE"
_LP = f"-(ln(len)+ln({_SD})+0.918938533192::DOUBLE+pow((ln(len)-{_MU})/{_SD},2)/2)"
_TABLE = f"""SELECT len, CASE WHEN done THEN -100 ELSE lp END AS lp, CASE WHEN done THEN 0 ELSE lnorm END AS lnorm FROM (
    SELECT *, coalesce(max(CASE WHEN lnorm > -1e-15::DOUBLE THEN 1 ELSE 0 END) OVER (ORDER BY len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=1 AS done FROM (
    SELECT len, {_LP} AS lp, ln(exp(-100::DOUBLE)+sum(exp({_LP})) OVER (ORDER BY len)) AS lnorm FROM (SELECT unnest(range(1, (SELECT max(length(text)) FROM documents)+1)) AS len)))"""


def _longest(d):
    return d.doc_trs.agg(F.max("length")).first()[0]


@query("length_lognorm", f"SELECT tid, CAST(length AS BIGINT) AS length, round(lnorm,6) AS lnorm FROM doc_trs JOIN ({_TABLE}) ON len = length")
def _(d):
    return scoring.length_lognorm(d.doc_trs, scoring.length_table(d.spark, *FIT, _longest(d)), *FIT)


# ---- base scores

_MATES = """SELECT tid, p, 1 AS mate, p AS pos, rl, s1 AS s, q1 AS q, back AS rev FROM frags UNION ALL SELECT tid, p, 2, p2, rl, s2, q2, NOT back FROM frags WHERE paired"""
_BASES = f"""SELECT tid, p, mate, rl, i, rev, substring(s, i, 1) AS b, substring(ref, i, 1) AS r, ascii(substring(q, i, 1))-33 AS qv FROM (
    SELECT *, unnest(range(1, rl+1)) AS i FROM (SELECT m.*, substring(seq, pos+1, rl) AS ref FROM ({_MATES}) m JOIN seqs ON seqs.tid = m.tid))"""
_SCORED = f"""SELECT tid, p, mate, sum(CASE WHEN same THEN hit ELSE mis END) AS lp_seq,
    sum(CASE WHEN NOT same THEN mis WHEN hit_rank <= least(greatest(1, 6-misses), hits) THEN mis ELSE hit END) AS low_seq FROM (
    SELECT *, row_number() OVER (PARTITION BY tid, p, mate, same ORDER BY CASE WHEN rev THEN i ELSE -i END) AS hit_rank, count(*) FILTER (same) OVER w AS hits, count(*) FILTER (NOT same) OVER w AS misses FROM (
    SELECT *, b = r AND r <> 'N' AS same, ln(1-exp(-qv/10::DOUBLE*ln(10))) AS hit, -qv/10::DOUBLE*ln(10) AS mis FROM ({_BASES})) WINDOW w AS (PARTITION BY tid, p, mate)) GROUP BY tid, p, mate"""


@query("seq_logprob", f"SELECT tid, p, CASE mate WHEN 1 THEN 'first' ELSE 'second' END AS mate, round(lp_seq,6) AS lp_seq, round(low_seq,6) AS low_seq FROM ({_SCORED})")
def _(d):
    mates = scoring.base_probabilities(scoring.with_reference(scoring.mates_of(d.frags), d.seqs))
    return mates.select(F.col("tid").cast("long").alias("tid"), (F.col("frag_seq") % PLACES).alias("p"), "mate", "lp_seq", "low_seq")


@query(
    "mismatch_freq",
    f"""SELECT CAST(k AS BIGINT) AS k, round(ln(h)-ln(h+m),6) AS log_hit, round(ln(m)-ln(h+m),6) AS log_mis FROM (
    SELECT CASE WHEN rev THEN rl-i ELSE i-1 END AS k, 1+count(*) FILTER (b=r) AS h, 1+count(*) FILTER (b<>r) AS m FROM ({_BASES}) WHERE r <> 'N' GROUP BY 1)""",
)
def _(d):
    return scoring.mismatch_freq(scoring.with_reference(scoring.mates_of(d.frags), d.seqs))


_UNIFORM = f"""SELECT f.read_id, f.tid, f.p, CASE WHEN paired THEN coalesce(t.lp,0)-n.lnorm ELSE 0 END - ln(tr_len-CASE WHEN paired THEN flen ELSE rl END+1) AS place, lp_seq, low_seq FROM frags f
    JOIN (SELECT tid, p, sum(lp_seq) AS lp_seq, sum(low_seq) AS low_seq FROM ({_SCORED}) GROUP BY 1,2) s ON s.tid=f.tid AND s.p=f.p LEFT JOIN ({_TABLE}) t ON t.len=f.flen JOIN ({_TABLE}) n ON n.len=f.tr_len"""


@query("alignment_logprob_uniform", f"SELECT read_id, CAST(tid+1 AS INT) AS tr_id, tid::BIGINT*{PLACES}+p AS frag_seq, round(place+lp_seq,6) AS lprob, round(place+low_seq,6) AS low_lprob FROM ({_UNIFORM})")
def _(d):
    return scoring.score_fragments(d.frags, d.doc_trs, d.seqs, FIT)


@query(
    "noise_alignment",
    f"""SELECT read_id, CAST(tid+1 AS INT) AS tr_id, round(place+lp_seq,6) AS lprob FROM ({_UNIFORM}) UNION ALL SELECT read_id, 0, round(least(min(place+low_seq),1),6) FROM ({_UNIFORM}) GROUP BY read_id""",
)
def _(d):
    return scoring.noise_alignment(scoring.score_fragments(d.frags, d.doc_trs, d.seqs, FIT))


# ---- effective lengths


@query(
    "effective_length_uniform",
    f"""SELECT tid, CASE WHEN v > 60 THEN round(v,4) ELSE length END AS eff_length FROM (SELECT tid, CAST(length AS DOUBLE) AS length, exp(-lnorm)*(length*cp-clp) AS v FROM doc_trs JOIN (
    SELECT len, lnorm, sum(exp(lp)) OVER (ORDER BY len) AS cp, sum(exp(lp)*len) OVER (ORDER BY len) AS clp FROM ({_TABLE})) ON len=length)""",
    4,
)
def _(d):
    table = scoring.length_table(d.spark, *FIT, _longest(d))
    density = scoring.length_density(table, *FIT, _longest(d))
    return scoring.effective_length_uniform(d.doc_trs, density, scoring.length_lognorm(d.doc_trs, table, *FIT), 60)


@query("effective_length_single_end", "SELECT tid, CAST(CASE WHEN length > 2000 THEN length-1000 WHEN length > 1000 THEN 1000 ELSE length END AS DOUBLE) AS eff_length FROM doc_trs")
def _(d):
    return scoring.effective_length_single_end(d.doc_trs, 1000)


# ---- read bias

_GRP = "CASE WHEN tr_len<1334 THEN 0 WHEN tr_len<2104 THEN 1 WHEN tr_len<2977 THEN 2 WHEN tr_len<4389 THEN 3 ELSE 4 END"
_OBS = f"""SELECT mate, CAST({_GRP} AS BIGINT) AS size_grp, CAST(least((pos-CASE WHEN mate=3 THEN 1 ELSE 0 END)*20//tr_len, 19) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM ends WHERE tr_len >= 20 GROUP BY 1,2,3"""
_UNI = f"""SELECT mate, CAST({_GRP} AS BIGINT) AS size_grp, CAST(CASE WHEN mate=5 THEN 19-i ELSE i END AS BIGINT) AS bin, sum(w/(tr_len-frag_len+1)*CASE WHEN i*tr_len/20::DOUBLE < frag_len THEN (i+1)*tr_len/20::DOUBLE-frag_len+1 ELSE tr_len/20::DOUBLE END) AS weight
    FROM (SELECT *, unnest(range(20)) AS i FROM (SELECT tid, tr_len, mate, frag_len, count(*)::DOUBLE AS w FROM ends WHERE tr_len >= 20 GROUP BY 1,2,3,4)) WHERE (i+1)*tr_len/20::DOUBLE > frag_len GROUP BY 1,2,3"""


def _ends(d):
    return bias.end_observations(_unique(d), d.doc_trs)


@query("pos_bias_observed", _OBS)
def _(d):
    return bias.pos_bias_observed(_ends(d))


@query("pos_bias_uniform", f"SELECT mate, size_grp, bin, round(weight,6) AS weight FROM ({_UNI})")
def _(d):
    return bias.pos_bias_uniform(_ends(d))


_POS_WEIGHT = f"""SELECT mate, size_grp, bin, (o/sum(o) OVER w)/(u/sum(u) OVER w) AS weight FROM (
    SELECT mate, size_grp, bin, coalesce(o.weight,0)+0.0005::DOUBLE AS o, coalesce(u.weight,0)+0.0005::DOUBLE AS u FROM (
    SELECT unnest([5,3]) AS mate, b//20 AS size_grp, b%20 AS bin FROM (SELECT unnest(range(100)) AS b)) LEFT JOIN ({_OBS}) o USING (mate, size_grp, bin) LEFT JOIN ({_UNI}) u USING (mate, size_grp, bin))
    WINDOW w AS (PARTITION BY mate, size_grp)"""


@query("pos_bias_weight", f"SELECT mate, size_grp, bin, round(weight,6) AS weight FROM ({_POS_WEIGHT})")
def _(d):
    e = cut_lineage(_ends(d))
    return bias.pos_bias_weight(bias.pos_bias_observed(e), bias.pos_bias_uniform(e))


_PARENTS = "[0,0,0,0,1,1,1,2,2,2,2,2,2,2,2,2,2,1,1,0,0]"


def _windows(positions: str) -> str:
    """The 23 bases around each of the rows (tid, mate, pos, ...), 3' ends read backwards."""
    return f"""SELECT * EXCLUDE (piece, blk, first, win), CASE WHEN mate=5 THEN win ELSE reverse(win) END AS win FROM (
        SELECT *, substring(piece, CAST(first%64+1 AS BIGINT), 23) AS win FROM (SELECT *, first//64 AS blk FROM (SELECT *, pos+CASE WHEN mate=5 THEN 30 ELSE 27 END AS first FROM ({positions}))) JOIN cuts USING (tid, blk))"""


def _node_counts(positions: str) -> str:
    """Base counts per node from rows (tid, mate, pos, w), unknown bases spread evenly."""
    letters = f"""SELECT mate, node, w, {_PARENTS}[node+1] AS depth, substring(win, node+1, 1) AS x, substring(win, node+2, 1) AS y, substring(win, node+3, 1) AS z FROM (
        SELECT mate, w, win, unnest(range(21)) AS node FROM (SELECT mate, win, sum(w) AS w FROM ({_windows(positions)}) GROUP BY 1,2))"""

    def choices(col: str, depth: int) -> str:
        return f"CASE WHEN depth < {depth} THEN [''] WHEN {col}='N' THEN ['A','C','G','T'] ELSE [{col}] END"

    summed = f"SELECT mate, node, depth, CASE WHEN depth<2 THEN '' ELSE x END AS x, CASE WHEN depth<1 THEN '' ELSE y END AS y, z, sum(w) AS w FROM ({letters}) GROUP BY ALL"
    return f"""SELECT mate, CAST(node AS INT) AS node, bpp, bp, b, sum(w/k1/k2/k3) AS weight FROM (
        SELECT *, unnest(c3) AS b FROM (SELECT *, unnest(c2) AS bp FROM (SELECT *, unnest(c1) AS bpp FROM (
        SELECT *, len(c1) AS k1, len(c2) AS k2, len(c3) AS k3 FROM (SELECT mate, node, w, {choices('x', 2)} AS c1, {choices('y', 1)} AS c2, {choices('z', 0)} AS c3 FROM ({summed})))))) GROUP BY 1,2,3,4,5"""


_SEQ_COUNTS = _node_counts("SELECT tid, mate, pos, 1::DOUBLE AS w FROM ends")


@query("seq_bias_counts", f"SELECT mate, node, bpp, bp, b, round(weight,6) AS weight FROM ({_SEQ_COUNTS})")
def _(d):
    return bias.seq_bias_counts(_ends(d), d.seqs)


# Expected ends of each position, and the bases around them.
_EXPECTED = """SELECT tid, mate, CAST(CASE WHEN mate=5 THEN spot ELSE spot+1 END AS BIGINT) AS pos, w FROM (
    SELECT tid, mate, spot, sum(coalesce(d,0)) OVER (PARTITION BY tid, mate ORDER BY spot) AS w FROM (SELECT DISTINCT tid, mate, tr_len, unnest(range(tr_len)) AS spot FROM (SELECT DISTINCT tid, mate, tr_len FROM ends))
    LEFT JOIN (SELECT tid, mate, spot, sum(d) AS d FROM (
        SELECT tid, mate, CASE WHEN mate=5 THEN 0 ELSE frag_len-1 END AS spot, 1::DOUBLE/(tr_len-frag_len+1) AS d FROM ends
        UNION ALL SELECT tid, mate, tr_len-frag_len+1, -1::DOUBLE/(tr_len-frag_len+1) FROM ends WHERE mate=5) GROUP BY 1,2,3) USING (tid, mate, spot)) WHERE w > 1e-12::DOUBLE"""
_SEQ_EXPECTED = _node_counts(_EXPECTED)


@query("seq_bias_uniform", f"SELECT mate, node, bpp, bp, b, round(weight,3) AS weight FROM ({_SEQ_EXPECTED})", 3)
def _(d):
    return bias.seq_bias_uniform(_ends(d), d.seqs)


def _node_probs(counts: str) -> str:
    return f"""SELECT mate, node, bpp, bp, b, w/sum(w) OVER (PARTITION BY mate, node, bpp, bp) AS prob FROM (
    SELECT mate, node, bpp, bp, b, coalesce(weight,0)+0.01::DOUBLE/pow(4,depth+1) AS w FROM (
      SELECT mate, node, depth, bpp, bp, unnest(['A','C','G','T']) AS b FROM (SELECT *, unnest(CASE WHEN depth<1 THEN [''] ELSE ['A','C','G','T'] END) AS bp FROM (
      SELECT *, unnest(CASE WHEN depth<2 THEN [''] ELSE ['A','C','G','T'] END) AS bpp FROM (SELECT *, {_PARENTS}[node+1] AS depth FROM (SELECT unnest([5,3]) AS mate, CAST(n AS INT) AS node FROM (SELECT unnest(range(21)) AS n))))))
    LEFT JOIN ({counts}) USING (mate, node, bpp, bp, b))"""


@query("seq_bias_norm", f"SELECT mate, node, bpp, bp, b, round(prob,6) AS prob FROM ({_node_probs(_SEQ_COUNTS)})")
def _(d):
    return bias.seq_bias_norm(bias.seq_bias_counts(_ends(d), d.seqs))


def _model(d: Domain):
    e = cut_lineage(_ends(d))
    return e, bias.BiasModel.fit(e, d.seqs)


def _by_triple(probs: str) -> str:
    """mate, node, k, prob of every letter triple; unknown letters before are averaged, an unknown base has a quarter."""
    return f"""SELECT mate, node, x||y||z AS k, CASE WHEN z='N' THEN 0.25::DOUBLE ELSE avg(prob) END AS prob FROM ({probs}),
        (SELECT * FROM (SELECT unnest(['A','C','G','T','N']) AS x), (SELECT unnest(['A','C','G','T','N']) AS y), (SELECT unnest(['A','C','G','T','N']) AS z))
        WHERE (bpp='' OR x='N' OR bpp=x) AND (bp='' OR y='N' OR bp=y) AND (z='N' OR b=z) GROUP BY mate, node, x, y, z"""


_RATIO = f"""ratio AS MATERIALIZED (SELECT mate, node, k, r.prob/f.prob AS r FROM ({_by_triple(_node_probs(_SEQ_COUNTS))}) r JOIN ({_by_triple(_node_probs(_SEQ_EXPECTED))}) f USING (mate, node, k))"""


def _end_ratios(spots: str) -> str:
    """Sequence ratio of rows (tid, mate, pos)."""
    return f"""SELECT tid, mate, pos, ratio FROM ({_windows(spots)}) JOIN (SELECT mate, win, product(r) AS ratio FROM (
        SELECT mate, win, node, substring(win, node+1, 3) AS k FROM (SELECT mate, win, unnest(range(21)) AS node FROM (SELECT DISTINCT mate, win FROM ({_windows(spots)})))) JOIN ratio USING (mate, node, k) GROUP BY ALL) USING (mate, win)"""


# Weights of all positions: a 5' end's start, a 3' end's last base.
_WEIGHTS = f"""{_RATIO}, places AS (SELECT tid, mate, CASE WHEN mate=5 THEN spot ELSE spot+1 END AS pos FROM (SELECT tid, unnest([5,3]) AS mate, spot FROM (SELECT tid, unnest(range(length)) AS spot FROM doc_trs))),
    weights AS MATERIALIZED (SELECT tid, mate, spot, n, ratio*CASE WHEN n < 20 THEN 1 ELSE w.weight END AS w FROM (SELECT tid, mate, CASE WHEN mate=5 THEN pos ELSE pos-1 END AS spot, ratio, length AS n, length AS tr_len FROM ({_end_ratios("SELECT * FROM places")}) JOIN doc_trs USING (tid))
        LEFT JOIN ({_POS_WEIGHT}) w USING (mate) WHERE w.size_grp = {_GRP} AND w.bin = least(spot*20//greatest(n, 1), 19)),
    along AS MATERIALIZED (SELECT tid, any_value(n) AS n, list(w ORDER BY spot) FILTER (mate=5) AS five, list(w ORDER BY spot) FILTER (mate=3) AS three FROM weights GROUP BY tid)"""


def _norms(wanted: str) -> str:
    """Sums of weights of rows (tid, kind, frag_len)."""
    return f"""SELECT tid, kind, frag_len, CASE kind WHEN 0 THEN list_sum(five[1:n-frag_len+1]) WHEN 1 THEN list_sum(three[frag_len:n]) ELSE list_dot_product(five[1:n-frag_len+1], three[frag_len:n]) END AS norm
        FROM ({wanted}) JOIN along USING (tid)"""


_KIND = "CASE WHEN paired THEN 2 WHEN back THEN 1 ELSE 0 END"


@query("seq_bias_ratio", f"WITH {_RATIO} SELECT tid, mate, pos, round(ratio,6) AS ratio FROM ({_end_ratios('SELECT DISTINCT tid, mate, pos FROM ends')})")
def _(d):
    e, model = _model(d)
    return bias.seq_bias_ratio(e, model)


@query("weight_norm", f"WITH {_WEIGHTS} SELECT tid, kind, frag_len, round(norm,2) AS norm FROM ({_norms(f'SELECT DISTINCT tid, {_KIND} AS kind, frag_len FROM uniq UNION SELECT tid, CASE WHEN mate=5 THEN 0 ELSE 1 END, frag_len FROM ends')})", 2)
def _(d):
    """Of each end's length and of each unique fragment's."""
    e, model = _model(d)
    ends = e.select("tid", F.when(F.col("mate") == 5, 0).otherwise(1).alias("_kind"), "frag_len")
    kind = F.when(F.col("paired"), 2).when(flag_set(F.col("first.flag"), REVERSE), 1).otherwise(0)
    whole = _unique(d).select(F.col("first.tid").cast("long").alias("tid"), kind.alias("_kind"), F.col("frag_len").cast("long").alias("frag_len"))
    return bias.weight_norms(ends.unionByName(whole).distinct(), d.seqs, model.pos, model.ratio).withColumnRenamed("_kind", "kind")


_BIASED = f"""SELECT f.read_id, f.tid, f.p, CASE WHEN f.paired THEN coalesce(t.lp,0)-l.lnorm ELSE 0 END + ln(CASE WHEN f.kind=1 THEN 1 ELSE five[f.p+1] END*CASE WHEN f.kind=0 THEN 1 ELSE three[f.last] END) - ln(norm) AS place
    FROM (SELECT *, {_KIND} AS kind, CASE WHEN paired THEN flen ELSE rl END AS frag_len, CASE WHEN paired THEN p2 ELSE p END+rl AS last FROM frags WHERE NOT (paired AND back)) f JOIN along USING (tid)
    JOIN ({_norms(f'SELECT DISTINCT tid, {_KIND} AS kind, CASE WHEN paired THEN flen ELSE rl END AS frag_len FROM frags')}) USING (tid, kind, frag_len)
    LEFT JOIN ({_TABLE}) t ON t.len=f.flen JOIN ({_TABLE}) l ON l.len=f.tr_len"""


@query(
    "alignment_logprob_bias",
    f"""WITH {_WEIGHTS} SELECT f.read_id, CASE WHEN place IS NOT NULL THEN CAST(f.tid+1 AS INT) ELSE -1 END AS tr_id, f.tid::BIGINT*{PLACES}+f.p AS frag_seq, round(place+lp_seq,6) AS lprob, round(place+low_seq,6) AS low_lprob FROM frags f
    LEFT JOIN ({_BIASED}) b ON b.tid=f.tid AND b.p=f.p LEFT JOIN (SELECT tid, p, sum(lp_seq) AS lp_seq, sum(low_seq) AS low_seq FROM ({_SCORED}) GROUP BY 1,2) s ON s.tid=f.tid AND s.p=f.p""",
)
def _(d):
    """Fragments of the wrong strand have tr_id -1 and no probability."""
    _, model = _model(d)
    return scoring.score_fragments(d.frags, d.doc_trs, d.seqs, FIT, bias=model).withColumn("tr_id", F.coalesce("tr_id", F.lit(-1)))


# Lengths as far as their density counts.
_LIKELY = f"SELECT tid, unnest(range(1, least(n, CAST(ceil(exp({_MU}-{_SD}*{_SD}+{_SD}*sqrt(90::DOUBLE))) AS BIGINT))+1)) AS frag_len, 2 AS kind FROM along"


@query(
    "effective_length_bias",
    f"""WITH {_WEIGHTS}, raw AS (SELECT tid, length, CASE WHEN v > 1 THEN v ELSE length END AS raw FROM (
        SELECT tid, length, exp(-lnorm)*coalesce(s,0) AS v FROM doc_trs JOIN ({_TABLE}) ON len=length LEFT JOIN (
        SELECT tid, sum(exp({_LP})*norm) AS s FROM (SELECT tid, frag_len AS len, norm FROM ({_norms(_LIKELY)})) GROUP BY 1) USING (tid)))
    SELECT tid, round(raw*(SELECT sum(length)/sum(raw) FROM raw),4) AS eff_length FROM raw""",
    4,
)
def _(d):
    _, model = _model(d)
    table = scoring.length_table(d.spark, *FIT, _longest(d))
    return bias.effective_length_bias(d.doc_trs, d.seqs, model, scoring.length_lognorm(d.doc_trs, table, *FIT), *FIT)


# ---- legacy layout


def _marks(ref: Column, seq: Column) -> Column:
    """Offsets of the bases of ``seq`` that aren't those of ``ref``, in the legacy layout.

    Letters side by side: a lambda that cuts one letter out of a derived column derives the column anew for each.
    """
    differ = F.zip_with(F.split(ref, ""), F.split(seq, ""), lambda r, b: b.isNotNull() & ~r.eqNullSafe(b))
    return F.concat_ws(",", F.transform(differ, lambda other, i: F.when(other, F.concat(i.cast("string"), F.lit(":N>N")))))


@query(
    "legacy_map_probs",
    f"""SELECT tid, p, round(exp(sum(CASE WHEN b <> r THEN -qv/10::DOUBLE*ln(10) ELSE ln(1-exp(-qv/10::DOUBLE*ln(10))) END)),9) AS prob FROM ({_BASES}) WHERE mate = 1 GROUP BY tid, p""",
    9,
)
def _(d):
    """First mates written in the legacy layout, read back and scored."""
    x = scoring.with_reference(scoring.mates_of(d.frags).filter("mate = 'first'"), d.seqs)
    path = scratch_path(d.spark, "map")
    strand = F.when(F.col("reversed"), "-").otherwise("+")
    lines = F.concat_ws("\t", F.col("frag_seq").cast("string"), strand, F.col("tid").cast("string"), F.col("pos").cast("string"), "seq", "qual", F.lit("0"), _marks(F.col("ref"), F.col("seq")))
    x.select(lines.alias("value")).write.text(path)
    probs = legacy.legacy_map_probs(aln.read_bowtie_map(d.spark, path))
    return probs.select(F.col("transcript").cast("long").alias("tid"), F.col("pos").cast("long").alias("p"), "prob")


def _nested(term, terms: int) -> str:
    """A series or continued fraction from its last term to its first."""
    out = "1::DOUBLE"
    for k in range(terms, 0, -1):
        out = term(k, out)
    return out


_TAIL_FIT = (14.0, 0.1)
_SERIES = _nested(lambda k, rest: f"(1 + 2*a*a/{2 * k + 1}*{rest})", numeric.ERFC_TERMS)
_FRACTION = _nested(lambda k, rest: f"(1 + {k}/(2*greatest(a*a, 1e-18::DOUBLE))/{rest})", numeric.ERFC_TERMS)


@query(
    "length_tail",
    f"""SELECT tid, length, round(ln(0.5::DOUBLE) + CASE WHEN x < 0 THEN CASE WHEN a < {numeric.ERFC_SWITCH} THEN ln(1 + erf) ELSE ln(2 - exp(beyond)) END WHEN a < {numeric.ERFC_SWITCH} THEN ln(1 - erf) ELSE beyond END, 6) AS lnorm FROM (
    SELECT tid, length, x, a, 2/sqrt(pi())*a*exp(-a*a)*{_SERIES} AS erf, -a*a - ln(greatest(a, 1e-9::DOUBLE)*sqrt(pi())*{_FRACTION}) AS beyond FROM (
    SELECT tid, length, x, abs(x) AS a FROM (SELECT tid, length, ({_TAIL_FIT[0]}::DOUBLE - ln(length::DOUBLE))/({_TAIL_FIT[1]}::DOUBLE*sqrt(2::DOUBLE)) AS x FROM (SELECT tid, length::BIGINT*1000 AS length FROM parts))))""",
)
def _(d):
    """Parts a thousand times as long, all beyond the table."""
    long = d.parts.select("tid", (F.col("length").cast("long") * 1000).alias("length"))
    return long.select("tid", "length", scoring.tail_lognorm(F.col("length"), *_TAIL_FIT).alias("lnorm"))

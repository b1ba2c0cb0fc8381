"""Hand-computed fixtures, golden vectors, skew paths and sampler properties."""

import gzip
import itertools
import math
import struct
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readweave import session
from readweave.functions import draws
from readweave.functions import dna, numeric, random as rnd
from readweave.functions.order import credible_interval, cumulative_counts
from readweave.functions.ranking import global_rank
from readweave.operators import bias, contrasts, convergence, expression as de, fragments, genes, hits, hyper, samples, scoring, smoothing
from readweave.operators import sampling, variational as vb
from readweave.plans import alignment_queries
from readweave.plans.domain import Domain
from readweave.sources import alignments as aln, sequence, tables, writers
from readweave.sources.lines import parse_header


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_header_tokens():
    flags = parse_header(["# T (M rows,N cols)", "# M 5", "# N 7", "1 2 # M 9"])
    assert "T" in flags and flags["M"] == 5 and flags["N"] == 7


def test_special_functions(spark):
    x = [1e-6, 0.3, 1.0, 2.0, 7.7, 25.0, 1e6]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", numeric.lgamma(F.col("x")).alias("l"), numeric.digamma(F.col("x")).alias("d"))
    for r in df.collect():
        assert r.l == pytest.approx(math.lgamma(r.x), abs=1e-9, rel=1e-12)
        if r.x > 1e-5:
            h = 1e-5 * max(r.x, 1)
            assert r.d == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), abs=1e-4)


def test_zero_rules(spark):
    one = spark.createDataFrame([(0.0,), (-1.0,)], "x double")
    assert [r[0] for r in one.select(numeric.safe_log(F.col("x"), "le0")).collect()] == [-100.0, -100.0]
    assert one.select(numeric.safe_log(F.col("x"), "ieee")).first()[0] == float("-inf")
    with pytest.raises(Exception, match="non-positive"):
        one.select(numeric.safe_log(F.col("x"), "error")).collect()


LOWESS_X = [1, 2, 3, 4, 5] + [6] * 10 + [8, 10, 12, 14, 50]
LOWESS_Y = [18, 2, 15, 6, 10, 4, 16, 11, 7, 3, 14, 17, 20, 12, 9, 13, 1, 8, 5, 19]


@pytest.mark.parametrize(
    "steps, delta, expected",
    [
        (0, 0.0, [13.659, 11.145, 8.701, 9.722, 10.000] + [11.300] * 10 + [13.000, 6.440, 5.596, 5.456, 18.998]),
        (0, 3.0, [13.659, 12.347, 11.034, 9.722, 10.511] + [11.300] * 10 + [13.000, 6.440, 5.596, 5.456, 18.998]),
        (2, 0.0, [14.811, 12.115, 8.984, 9.676, 10.000] + [11.346] * 10 + [13.000, 6.734, 5.744, 5.415, 18.998]),
    ],
)
def test_lowess_golden(steps, delta, expected):
    assert smoothing.lowess(LOWESS_X, LOWESS_Y, 0.25, steps, delta) == pytest.approx(expected, abs=6e-4)


def series(spark, *files):
    data = [(f, 0, n, float(v)) for f, values in enumerate(files) for n, v in enumerate(values)]
    return spark.createDataFrame(data, "file_idx int, tr long, n long, value double")


def test_variances(spark):
    s = series(spark, [1, 3, 2, 7])
    r = samples.variance_sample(s, log=False).first()
    assert (r.mean, r.var) == pytest.approx((3.25, 5.1875))
    r = samples.variance_sqdif(s, log=False).first()
    assert (r.mean, r.var) == pytest.approx((3.25, 4.25))


def test_pplr(spark):
    r = contrasts.pplr(series(spark, [1, 2, 4, 8], [2, 2, 2, 16])).first()
    assert (r.pplr, r.log2fc, r.ci_low, r.ci_high) == pytest.approx((0.5, 0.25, -1.0, 1.0))


def test_gene_expression_interleaved(spark):
    tr = spark.createDataFrame([(0, "g1", "a", 100, 100.0), (1, "g2", "b", 100, 100.0), (2, "g1", "c", 200, 200.0)], "tid long, gene string, transcript string, length int, eff_length double")
    s = spark.createDataFrame([(0, 0, 0, 0.5), (0, 1, 0, 0.25), (0, 2, 0, 0.25)], "file_idx int, tr long, n long, value double")
    assert rows(genes.gene_expression(s, tr), "gene", "value") == [("g1", 0.75), ("g2", 0.25)]
    adjusted = dict(rows(genes.gene_expression(s, tr, rpkm=True), "gene", "value"))
    assert adjusted == pytest.approx({"g1": 7.142857142857e9, "g2": 2.857142857e9})
    within = dict(rows(genes.within_gene(s, tr, adjust=True), "tr", "value"))
    assert within == pytest.approx({0: 0.8, 2: 0.2, 1: 1.0})
    assert rows(genes.gene_index(tr), "gene_idx", "gene") == [(0, "g1"), (1, "g2")]
    assert dict(rows(genes.check_tr_grouping(tr), "gene", "islands")) == {"g1": 2, "g2": 1}


def test_prob_merge_and_normalise(spark):
    h = spark.createDataFrame([("r1", 1, -1.0), ("r1", 1, -1.0), ("r1", 2, -2.0), ("r1", 0, -8.0)], "read_id string, tr_id long, lprob double")
    assert dict(rows(hits.dedupe_alignments(h), "tr_id", "lprob"))[1] == pytest.approx(-0.3068528, abs=1e-6)
    p = dict(rows(hits.normalise_alignments(h), "tr_id", "prob"))
    assert p == pytest.approx({1: 0.844312, 2: 0.155303, 0: 0.000385}, abs=1e-6)


def test_laid_out_hits_merge_by_one_sort(spark):
    """Equal to merging by groups for odd values too, and no table of all hits of a task is kept for it."""
    inf = float("inf")
    data = [("r", 1, -1.0), ("r", 1, -1.0), ("r", 1, -900.0), ("r", 0, -8.0), ("r", 3, None), ("r", 3, -1.0), (None, None, -1.0), (None, None, -2.0)]
    data += [("q", 1, -inf), ("q", 2, -3.0), ("q", 2, -inf), ("x", None, -1.0), ("w", 1, None), ("z", 1, float("nan"))]
    h = spark.createDataFrame(data, "read_id string, tr_id long, lprob double")
    key = lambda r: (str(r.read_id), str(r.tr_id))
    got, want = (sorted(x.collect(), key=key) for x in (hits.merge_laid_out(h.repartition("read_id")), hits.dedupe_alignments(h)))
    short = lambda rows: [(*key(r), None if r.lprob is None else f"{r.lprob:.9f}") for r in rows]
    assert short(got) == short(want)
    plan = hits.normalise_alignments(h)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_nearest_params(spark):
    params = spark.createDataFrame([(0.0, 1.0, 1.0), (2.0, 2.0, 2.0), (4.0, 3.0, 3.0)], "expr double, alpha double, beta double")
    q = spark.createDataFrame([(v,) for v in (-1.0, 1.0, 2.0, 3.0, 9.0)], "expr double")
    assert [a for _, a in rows(de.nearest_params(q, params), "expr", "alpha")] == [1.0, 2.0, 2.0, 3.0, 3.0]


def test_de_posterior(spark):
    s = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 0, 2.0)], "tr long, cond int, n long, value double")
    prior = spark.createDataFrame([(0, 0, 1.0, 3.0, 1.0)], "tr long, cond int, mu00 double, alpha double, beta double")
    r = de.de_posterior(s, prior, logged=True).first()
    assert (r.post_alpha, r.post_beta, r.post_mean) == pytest.approx((4.0, 2.0, 1.0))
    means = spark.createDataFrame([(0, 1.0)], "tr long, mean double")
    assert hyper.hyper_badd(s, means, logged=True).first().badd == pytest.approx(1.0)


def frag(seq_id, qname, flag, pos=0, tid=0, seq="ACGT", qual="IIII", cigar="4M"):
    return (qname, flag, "t", tid, pos, 255, cigar, seq, qual, seq_id)


def test_uniform_score(spark):
    tr = spark.createDataFrame([(0, "g", "t", 10, 10.0)], "tid long, gene string, transcript string, length int, eff_length double")
    seqs = spark.createDataFrame([(0, "t", "g", "TTACGTTTTT")], "tid long, name string, gene string, seq string")
    rec = spark.createDataFrame([frag(0, "q", 0, pos=2)], aln.SAM_SCHEMA)
    f = fragments.group_reads(fragments.pair_fragments(rec))
    out = dict(rows(scoring.noise_alignment(scoring.score_fragments(f, tr, seqs, None)), "tr_id", "lprob"))
    assert out[1] == pytest.approx(-1.9463102, abs=1e-6)
    assert out[0] == pytest.approx(-38.7872717, abs=1e-6)


def test_indels_and_learned_frequencies(spark):
    seqs = spark.createDataFrame([(0, "ACGTACGTAC")], "tid long, seq string")
    mates = spark.createDataFrame(
        [(0, "first", 0, 0, "2M1D2M", "ACTA", "*", False), (1, "first", 0, 0, "2M1I1M", "ACTG", "*", True)],
        "frag_seq long, mate string, tid long, pos int, cigar string, seq string, qual string, reversed boolean",
    )
    x = scoring.with_reference(mates, seqs)
    freq = scoring.mismatch_freq(x)
    got = {r.k: (r.log_hit, r.log_mis) for r in freq.collect()}
    # read 1 pairs AC.TA with all matches; read 2 pairs AC.G, its inserted base (position 1 from the end) is skipped
    assert got[0] == pytest.approx((math.log(3 / 4), math.log(1 / 4)))
    assert got[1] == pytest.approx((math.log(2 / 3), math.log(1 / 3)))
    scored = {r.frag_seq: r.lp_seq for r in scoring.base_probabilities(x, freq).collect()}
    assert scored[0] == pytest.approx(sum(got[k][0] for k in range(4)))
    assert scored[1] == pytest.approx(got[0][0] + got[2][0] + got[3][0])


def test_pairing_and_grouping(spark):
    recs = [frag(0, "a/1", 67), frag(1, "a/2", 131), frag(2, "b", 0), frag(3, "c", 67), frag(4, "c", 131), frag(5, "d", 67), frag(6, "d", 4), frag(7, "qa", 0), frag(8, "qb", 0)]
    f = fragments.group_reads(fragments.pair_fragments(spark.createDataFrame(recs, aln.SAM_SCHEMA)))
    assert rows(f, "frag_seq", "paired") == [(0, True), (2, False), (3, True), (5, True), (7, False), (8, False)]
    assert len({r.read_id for r in f.collect()}) == 6
    c = fragments.read_counts(fragments.read_summary(f)).first()
    assert (c.n_total, c.n_map, c.paired_n, c.single_n) == (6, 6, 3, 3)


def test_sam_and_bam_agree(spark, tmp_path):
    text = "@SQ\tSN:t0\tLN:10\n@SQ\tSN:t1\tLN:20\nq1\t0\tt1\t3\t255\t4M\t*\t0\t0\tACGT\tIIII\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*\n"
    (tmp_path / "x.sam").write_text(text)
    sam = rows(aln.read_sam(spark, str(tmp_path / "x.sam")), "qname", "flag", "rname", "tid", "pos", "cigar", "seq", "qual")

    def record(name, flag, tid, pos, cigar, seq, qual):
        nib = [aln._BASES.index(c) for c in seq] + [0]
        packed = bytes((nib[i] << 4) | nib[i + 1] for i in range(0, len(seq), 2))
        quals = b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=XB".index(o)) for n, o in cigar)
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 255, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + quals
        return struct.pack("<i", len(body)) + body

    refs = b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", size) for n, size in ((b"t0", 10), (b"t1", 20)))
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2) + refs + record("q1", 0, 1, 2, [(4, "M")], "ACGT", "IIII") + record("q2", 4, -1, -1, [], "ACG", "*")
    with gzip.open(tmp_path / "x.bam", "wb") as out:
        out.write(data)
    assert rows(aln.read_bam(spark, str(tmp_path / "x.bam")), "qname", "flag", "rname", "tid", "pos", "cigar", "seq", "qual") == sam


def test_prob_layouts(spark, tmp_path):
    (tmp_path / "log.prob").write_text("# Ntotal 3\n# Nmap 2\n# M 3\n# LOGFORMAT\nr1 2 1 -1.5 0 -9\nr2 2 2 x 0 -9\nr3 1 1 -1\n")
    got = rows(tables.read_prob(spark, str(tmp_path / "log.prob")), "read_id", "tr_id", "lprob")
    assert got == [("r1", 0, -9.0), ("r1", 1, -1.5), ("r2", 0, 10.0)]
    tr = spark.createDataFrame([(0, 4)], "tid long, length int")
    (tmp_path / "old.prob").write_text("# Nmap 1\nr1 2 alignments: 1 + 0.5 0 + 0.25\n")
    old = dict(rows(tables.read_prob(spark, str(tmp_path / "old.prob"), tr), "tr_id", "lprob"))
    assert old == pytest.approx({1: math.log(0.125), 0: math.log(0.25)})


def test_samples_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(0, t, n, t * 10.0 + n) for t in range(3) for n in range(4)], "file_idx int, tr long, n long, value double")
    for name, transposed in (("t", True), ("n", False)):
        writers.write_samples(s, str(tmp_path / name), transposed=transposed)
        back = tables.read_samples(spark, str(tmp_path / name))
        assert rows(back, "tr", "n", "value") == rows(s, "tr", "n", "value")


def test_gene_models_from_exons(spark):
    exon = 'gene_id "G1"; transcript_id "T";'
    lines = [f"chr1\ts\texon\t11\t20\t.\t-\t.\t{exon}", f"chr1\ts\texon\t31\t40\t.\t-\t.\t{exon}", 'chr1\ts\texon\t1\t5\t.\t+\t.\tgene_id "G2";', "chr1\ts\tCDS\t1\t5\t.\t+\t.\tx"]
    from readweave.operators import annotation

    gtf = sequence.parse_gtf(spark.createDataFrame([(v,) for v in lines], "value string"))
    seq = "ACGTTGCAAC" * 5
    genome = spark.createDataFrame([("1", seq)], "chromosome string, seq string")
    out = annotation.gene_sequences(annotation.gene_models(gtf), gtf, genome).collect()
    want = seq[10:40][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert [(r.gene_id, r.start, r.end, r.seq) for r in out] == [("G1", 11, 40, want)]


def test_strip_tail(spark):
    texts = ["", "ACGT", "AC!GT", "ACGT!x", "!!", "AC\n", "AC!\n", "\nAC", "n-Zé", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", sequence.strip_tail(F.col("s")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["", "ACGT", "AC!GT", "ACGT", "", "AC", "AC", "\nAC", "n-", None]


def test_gene_sequences_read_exons_once(spark):
    from readweave.operators import annotation

    lines = [f'{c}\ts\texon\t{s}\t{s + 9}\t.\t+\t.\tgene_id "{g}";' for c, s, g in [("chr1", 11, "A"), ("chr1", 31, "A"), ("2", 1, "B"), ("2", 21, "B"), ("3", 1, "C"), ("chr4", 1, "D"), ("5", 1, "D"), ("chr6", 1, "E"), ("chr6", 5, "E")]]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    gtf = sequence.parse_gtf(spark.createDataFrame([(v,) for v in lines], "value string").mapInPandas(count, "value string"))
    seq = {n: "ACGTTGCAAC" * 4 + n.replace("chr", "N" * int(n[-1])) for n in ("1", "2", "chr2", "4", "5", "chr7")}
    genome = spark.createDataFrame(list(seq.items()), "chromosome string, seq string")
    got = sorted((r.seqname, r.gene_id, r.start, r.end, r.seq) for r in annotation.gene_sequences(annotation.gene_models(gtf), gtf, genome).collect())
    doubled = "".join(sorted([seq["2"][:30]] * 2))  # both 2 and, as it has no gene of its own, chr2
    assert got == [("2", "B", 1, 30, doubled), ("5", "D", 1, 10, seq["5"][:10]), ("chr1", "A", 11, 40, seq["1"][10:40]), ("chr4", "D", 1, 10, seq["4"][:10])]
    assert read.value == len(lines)


def test_order_statistics_same_when_split(spark):
    data = [(k % 2, float((k * 37) % 501)) for k in range(4000)]
    df = spark.createDataFrame(data, "k int, v double")
    whole = rows(cumulative_counts(df, ["k"], "v"), "k", "v", "cnt", "n", "upto")
    assert rows(cumulative_counts(df, ["k"], "v", split_above=50), "k", "v", "cnt", "n", "upto") == whole
    assert rows(credible_interval(df, ["k"], "v", 95.0), "k", "ci_low") == rows(credible_interval(df, ["k"], "v", 95.0, split_above=50), "k", "ci_low")


def test_global_rank_with_heavy_value(spark):
    df = spark.range(5000).select(F.col("id").alias("tr"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 100 * 1.0).alias("x"))
    got = [r.tr for r in global_rank(df, "x", "tr", "r").orderBy("r").collect()]
    assert got == [i for _, i in sorted((7.0 if i % 3 == 0 else float(i % 100), i) for i in range(5000))]


def toy_hits(spark, n=400, m=12, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for r in range(n):
        for t in sorted(set(rng.integers(1, m, 3))):
            data.append((r, int(t), float(-rng.exponential())))
        data.append((r, 0, -8.0))
    return spark.createDataFrame(data, "read_id long, tr_id long, lprob double")


def dense_vb(spark_hits, m, iterations):
    """Plain numpy fixed point for comparison."""
    data = sorted(tuple(r) for r in spark_hits.collect())
    read, tr, lp = (np.array([d[i] for d in data]) for i in range(3))
    u = np.zeros(m)
    for _ in range(iterations):
        w = np.exp(lp + u[tr])
        phi = w / np.bincount(read, w)[read]
        count = np.bincount(tr, phi, minlength=m)
        h = 1e-4
        u = np.array([(math.lgamma(1 + c + h) - math.lgamma(1 + c - h)) / (2 * h) for c in count])
    return count


def test_variational_methods_agree_and_rise(spark):
    h = toy_hits(spark)
    steepest = vb.vb_optimise(vb.prepare_hits(h), 12, "steepest", max_iter=40)
    conjugate = vb.vb_optimise(vb.prepare_hits(h), 12, "FR", max_iter=25)
    for fit in (steepest, conjugate):
        assert all(b >= a - 1e-9 for a, b in zip(fit.bounds, fit.bounds[1:]))
    want = dense_vb(h, 12, len(steepest.bounds))
    got = {r.tr_id: r.phihat for r in steepest.state.collect()}
    assert [got[t] for t in range(12)] == pytest.approx(list(want), abs=0.05)
    assert conjugate.bounds[-1] == pytest.approx(steepest.bounds[-1], abs=0.5)


def test_classes_hold_all_hits(spark):
    h = toy_hits(spark, n=60)
    shifted = h.withColumn("read_id", F.col("read_id") + 1000).withColumn("lprob", F.col("lprob") - 1.5)
    got = vb.prepare_hits(h.unionByName(h).unionByName(shifted.filter("tr_id > 0")), block_hits=40)
    assert got.n_reads == h.select("read_id").distinct().count() + shifted.filter("tr_id > 0").select("read_id").distinct().count()
    back = got.frame.join(got.members, "cls").select("read_id", "tr_id", (F.col("rel") + F.col("top")).alias("lprob"))
    want = hits.dedupe_alignments(h.unionByName(h).unionByName(shifted.filter("tr_id > 0")))
    assert np.allclose(np.array(sorted(rows(back, "read_id", "tr_id", "lprob"))), np.array(sorted(rows(want, "read_id", "tr_id", "lprob"))))
    assert got.top == pytest.approx(want.groupBy("read_id").agg(F.max("lprob").alias("t")).agg(F.sum("t")).first()[0])
    assert sorted(rows(got.slots, "block", "tr_id")) == sorted(rows(got.frame.select("block", "tr_id").distinct(), "block", "tr_id"))


def test_alike_reads_are_one_class(spark):
    data = [(r, t, -t * 0.5 - r) for r in range(30) for t in (0, 3, 5)]
    got = vb.prepare_hits(spark.createDataFrame(data, "read_id long, tr_id long, lprob double"))
    assert [(r.n, r.tr_id) for r in got.frame.orderBy("tr_id").collect()] == [(30, 0), (30, 3), (30, 5)]


def test_reads_are_gathered_over_batches():
    """Reads that go on in the next batches, one without a name and hits without a value."""
    import pyarrow as pa
    from readweave.operators.classes import _gather

    data = [(None, 1, -1.0), (None, 2, -3.0), ("a", None, -2.0), ("a", 4, None), ("a", 5, -1.5), ("b", 1, None), ("c", 1, 0.0), ("c", 2, -1.0)]
    want = [(None, [1, 2], -1.0, [0.0, -2.0]), ("a", [None, 4, 5], -1.5, [-0.5, None, 0.0]), ("b", [1], None, [None]), ("c", [1, 2], 0.0, [0.0, -1.0])]
    names, types = ["read_id", "tr_id", "lprob"], [pa.string(), pa.int64(), pa.float64()]
    for size in (1, 2, 3, 5, 8):
        cut = [data[i : i + size] for i in range(0, len(data), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), types)], names) for rows_ in [*cut[:1], *cut[1:]]]
        got = [tuple(r.values()) for b in _gather(iter(batches)) for r in b.to_pylist()]
        assert got == want


def test_partitions_hold_several_blocks(spark):
    """One block a partition leaves some partitions empty and others with the work of three."""
    h = vb.prepare_hits(toy_hits(spark))
    per = h.frame.select("block", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
    assert len(per) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(r["count"] for r in per) > 1


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    """Neither the lines nor the records of a small header are exchanged."""
    (tmp_path / "x.sam").write_text("@SQ\tSN:t0\tLN:9\n@SQ\tSN:t1\tLN:9\n" + "".join(f"r{i}\t0\tt{i % 3}\t1\t255\t2M\t*\t0\t0\tAC\tII\n" for i in range(6)))
    got = aln.read_sam(spark, str(tmp_path / "x.sam"))
    assert [(r.qname, r.tid, r.file_seq) for r in got.orderBy("file_seq").collect()] == [(f"r{i}", (0, 1, -1)[i % 3], i + 2) for i in range(6)]
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_hits_stay_in_place(spark):
    """No step exchanges the hits, even where nothing may be broadcast."""
    h = vb.prepare_hits(toy_hits(spark), block_hits=100)
    h.frame.count(), h.slots.count()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = vb.scored(h, vb.start_state(h, 12), ["u"])
        root = step._jdf.queryExecution().executedPlan().initialPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

    def above(node, names):
        """Names of the operators above the scan of the hits."""
        if "InMemoryTableScan" in node.nodeName() and "rel#" in node.output().toString():
            return names
        children = node.children()
        return next((x for i in range(children.size()) if (x := above(children.apply(i), [*names, node.nodeName()]))), None)

    names = above(root, [])
    assert "SortMergeJoin" in names and "Window" in names and not any("Exchange" in n for n in names)


@pytest.mark.parametrize("collapsed", [False, True])
def test_chains_find_a_known_posterior(spark, collapsed):
    """Reads with one transcript each: counts are fixed, abundances are Dirichlet."""
    counts = {t: 20 * t for t in range(1, 13)}
    data = [(t * 1000 + i, t, 0.0) for t, c in counts.items() for i in range(c)]
    h = vb.prepare_hits(spark.createDataFrame(data, "read_id long, tr_id long, lprob double"))
    settings = sampling.ChainSettings(chains=4, burn_in=1, samples_n=4, samples_save=5, samples_nmax=5)
    run = sampling.estimate_expression(h, 13, 5, collapsed, settings, seed=9)
    assert run.draws.groupBy("chain", "n").agg(F.sum("theta").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    got = {r.tr: r.m for r in run.draws.groupBy("tr").agg(F.avg("theta").alias("m")).collect()}
    total = sum(counts.values()) + 12
    for t, c in counts.items():
        want = (c + 1) / total
        assert got[t - 1] == pytest.approx(want, abs=5 * math.sqrt(want / total / 20) + 1e-3)


@pytest.mark.parametrize(("collapsed", "started"), [(False, False), (True, False), (True, True)])
def test_chains_find_an_enumerated_posterior(spark, collapsed, started):
    """Reads with several hits, some alike, so that assignment has a choice; all assignments are weighed."""
    reads = [{1: 0.0, 2: -0.4, 0: -2.0}] * 3 + [{2: -0.3, 3: 0.0, 0: -1.5}, {1: -1.0, 3: 0.0, 0: -3.0}, {2: 0.0, 0: -0.5}]
    h = vb.prepare_hits(spark.createDataFrame([(i, t, p - i) for i, r in enumerate(reads) for t, p in r.items()], "read_id long, tr_id long, lprob double"))
    m, unmapped = 4, 2
    settings = sampling.ChainSettings(chains=600, burn_in=4, samples_n=1, samples_save=600, samples_nmax=1, beta_alpha=2.0, beta_beta=2.0)
    size = m if collapsed else m - 1
    weights, means = 0.0, np.zeros(m - 1)
    for z in itertools.product(*[r.items() for r in reads]):
        c = np.bincount([t for t, _ in z], minlength=m)
        n = len(reads) - c[0]
        lw = sum(p for _, p in z) + math.lgamma(2 + n) + math.lgamma(2 + unmapped + c[0]) - math.lgamma(size + n) + sum(math.lgamma(1 + k) for k in c[1:])
        weights += math.exp(lw)
        means += math.exp(lw) * (1 + c[1:]) / (m - 1 + n)
    fit = vb.vb_optimise(h, m, "steepest", max_iter=5).state if started else None
    run = sampling.estimate_expression(h, m, unmapped, collapsed, settings, seed=9, fit=fit)
    got = {r.tr: (r.m, r.v / r.n) for r in run.draws.groupBy("tr").agg(F.avg("theta").alias("m"), F.variance("theta").alias("v"), F.count("theta").alias("n")).collect()}
    for k, want in enumerate(means / weights):
        assert abs(got[k][0] - want) < 4.5 * math.sqrt(got[k][1])


def test_multinomial_counts():
    keys = np.arange(4000, dtype=np.int64) * 7919 - 10**15
    p = np.tile([0.2, 0.5, 0.3], 4000)
    got = sampling.multinomial_counts(keys, np.full(4000, 5), np.arange(3, 12001, 3), p).reshape(-1, 3)
    assert (got.sum(axis=1) == 5).all() and np.allclose(got.mean(axis=0), [1.0, 2.5, 1.5], atol=0.07)
    back = sampling.multinomial_counts(keys[::-1].copy(), np.full(4000, 5), np.arange(3, 12001, 3), p).reshape(-1, 3)
    assert (back[::-1] == got).all()


@pytest.mark.parametrize("uniform", [rnd.uniform, rnd.portable_uniform])
def test_gamma_moments(spark, uniform):
    for shape in (0.3, 1.0, 8.0):
        x = spark.range(60_000).select(rnd.gamma(5, F.lit(shape), F.col("id") * 7919, uniform=uniform).alias("g"))
        got = x.agg(F.avg("g").alias("m"), F.variance("g").alias("v"), F.count_if(F.col("g") <= 0).alias("low"), F.count_distinct("g").alias("n")).first()
        assert got.m == pytest.approx(shape, rel=0.03) and got.v == pytest.approx(shape, rel=0.1) and got.low == 0 and got.n > 59_900


@pytest.mark.parametrize("uniform", [rnd.uniform, rnd.portable_uniform])
def test_gamma_columns_are_the_same_draws(spark, uniform):
    x = spark.range(20_000).select("id", (F.col("id") % 9 / 4.0 + 0.1).alias("shape"))
    got = rnd.with_gamma(x.withColumn("one", rnd.gamma(5, F.col("shape"), "id", uniform=uniform)), "other", 5, F.col("shape"), "id", uniform=uniform)
    assert got.columns == ["id", "shape", "one", "other"]
    assert got.filter("NOT one <=> other OR one IS NULL").count() == 0


def test_gammas_of_arrays_are_the_same_draws(spark):
    rng = np.random.default_rng(8)
    keys = [(int(t), int(f), float(s)) for t, f, s in zip(rng.integers(0, 10 ** rng.integers(1, 12, 400)), rng.integers(0, 30, 400) * 50, rng.random(400) * 9 + 0.05, strict=True)]
    rows = spark.createDataFrame([*keys, (-3, 0, 2.0), (10**18, 900, 0.3), (7, 1480, 1.0)], "tr long, begin long, shape double").filter("begin < 1500")
    got = rows.select("tr", "begin", "shape", F.posexplode(draws.gammas(-12, 1500, 50)("tr", "begin", "shape")).alias("at", "g")).withColumn("n", F.col("begin") + F.col("at"))
    both = rnd.with_gamma(got, "one", -12, F.col("shape"), "tr", "n")
    seen = both.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("top"), F.max(F.abs(F.col("g") / F.col("one") - 1)).alias("off"), F.count_if(F.col("g").isNull() | F.col("one").isNull()).alias("none")).first()
    assert seen["n"] == 402 * 50 + 20 and seen["top"] == 1499 and seen["off"] < 1e-9 and not seen["none"]
    sums = rows.mapInArrow(draws.gamma_sums(-12, 1500, 50), "n long, sum double").groupBy("n").agg(F.sum("sum").alias("sum"))
    assert sums.join(got.groupBy("n").agg(F.sum("g").alias("g")), "n", "full").filter("NOT coalesce(abs(sum / g - 1) < 1e-9, false)").count() == 0


@pytest.mark.parametrize("kind", ["theta", "rpkm"])
def test_draws_are_dealt_to_all_tasks(spark, monkeypatch, kind):
    """Few rows make many draws; Spark would put so few bytes into one task."""
    seen = []
    written = vb.cut_lineage
    monkeypatch.setattr(vb, "cut_lineage", lambda df: seen.append(df.select(F.spark_partition_id().alias("p")).distinct().count()) or written(df))
    alphas = spark.range(60).groupBy((F.col("id") % 30).alias("tr_id")).agg(F.count(F.lit(1)).cast("double").alias("alpha"))
    lengths = spark.createDataFrame([(i, 100 + i) for i in range(28)] + [(3, 50), (4, 0), (5, None)], "tid long, length int")
    got = vb.vb_samples(alphas, 120, 1, kind, lengths).toPandas()
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    if kind == "theta":
        assert len(got) == 29 * 120 and np.allclose(got.groupby("n")["value"].sum(), 1.0)
    else:  # a row for each length of a transcript, none without one
        assert len(got) == 31 * 120 and sorted(got.loc[got["n"] == 7, "tr"].unique()) == list(range(28))
        theta = vb.vb_samples(alphas, 120, 1).toPandas().set_index(["tr", "n"])["value"]
        one = got[got["tr"] == 3].groupby("n")["value"].apply(sorted)
        assert all(np.allclose(v, [theta[3, n] / 103 * 1e9, theta[3, n] / 50 * 1e9]) for n, v in one.items())


def test_legacy_marks(spark):
    from readweave.plans.alignment_queries import _marks

    pairs = [("ACGT", "ACGT"), ("acgt", "ACCA"), ("NNNN", "ACGN"), ("ACG", "ACGT"), ("ACGTA", "AC"), ("A", "T"), ("A" * 60, "AC" * 30)]
    x = spark.createDataFrame(pairs, "raw string, seq string").withColumn("ref", F.upper("raw"))
    got = x.select("raw", "seq", _marks(F.col("ref"), F.col("seq")).alias("m"))
    for raw, seq, marks in got.collect():
        ref = raw.upper().ljust(len(seq), "-")
        assert marks == ",".join(f"{i}:N>N" for i, b in enumerate(seq) if ref[i] != b)
    # the derived column stands outside of the lambda
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and "substring(" not in plan


def test_block_pairs_join_near_texts_once(spark):
    """Both ends of short lengths lie in one text: a join of it with the lengths, not one for each end."""
    seqs = spark.createDataFrame([(1, "ACGTN" * 500), (2, "AC"), (3, "G" * bias.SPAN)], "tid long, seq string")
    asked = spark.createDataFrame([(1, 2500, 0), (1, 2500, 1), (1, 2500, 2), (2, 2, 0), (3, bias.SPAN, 0)], "tid long, _n long, _q long")
    got = bias._block_pairs(asked, seqs).collect()
    text = {r.tid: "N" * bias.MARGIN + r.seq + "N" * (3 * bias.SPAN) for r in seqs.collect()}
    assert sorted((r.tid, r._q, r._blk) for r in got) == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0), (1, 1, 1), (1, 2, 0), (2, 0, 0), (3, 0, 0)]
    for r in got:
        near, far = (text[r.tid][b * bias.SPAN :] for b in (r._blk, r._blk + r._q))
        assert near.startswith(r._near.rstrip("N")) and far.startswith(r._far.rstrip("N")) and len(r._near) <= bias.SPAN + 2 * bias.MARGIN
    short = bias._block_pairs(asked.filter("_q = 0"), seqs)._jdf.queryExecution().optimizedPlan().toString()
    assert short.count("Join") == 1


def test_thinning_rule(spark):
    for total, out in ((10, 5), (84, 30), (7, 7), (1000, 3)):
        df = spark.range(1, total + 1).withColumnRenamed("id", "i")
        got = [r.i for r in convergence.thinning(df, total, out).orderBy("i").collect()]
        assert got == sorted(convergence.kept_iterations(total, out)) and len(got) == out


def test_unique_places_are_numbers_of_observed_fragments(spark, tmp_path):
    from readweave.operators import fragments
    from readweave.plans.alignment_queries import _unique
    from readweave.plans.domain import Domain

    mate = "struct<qname:string,flag:int,tid:int,pos:int,cigar:string,seq:string,qual:string>"
    m = lambda name, flag, tid, pos, cigar="4M": (name, flag, tid, pos, cigar, "ACGT", "IIII")
    reads = [
        ("a", m("a/1", 67, 0, 3, "2M1D2M"), m("a/2", 131, 0, 9), True), ("b", m("b", 16, 1, 5), None, False),
        ("c", m("c", 0, 0, 1), None, False), ("c", m("c", 0, 1, 2), None, False), ("d", m("d", 4, -1, 0), None, False), ("d", m("d", 0, 1, 7), None, False),
        ("e", m("e", 67, 0, 3), m("e", 131, 1, 9), True), ("f", m("f", 67, 0, 3), m("g", 131, 0, 9), True), ("h", m("h", 83, 1, 20), m("h", 163, 1, 2), True),
        ("i", m("i", 0, 9, 1), None, False), (None, m("j", 0, 0, 1), None, False), ("k", m("k", 73, 1, 4), None, False), ("k", m("k", 0, 0, 4), None, False),
    ]
    df = spark.createDataFrame(reads, f"read_id string, first {mate}, second {mate}, paired boolean")
    cols = ["first.flag", "first.tid", "first.pos", "second.flag", "second.tid", "second.pos", "paired", "end1", "end2", "frag_len"]
    want = fragments.observe_unique(df, fragments.read_summary(df), 2).select(cols).collect()
    assert sorted(map(str, fragments.unique_places(df, 2).select(cols).collect())) == sorted(map(str, want)) and len(want) == 4
    # what the bias queries lay out by read
    docs = [(i, "lorem ipsum dolor sit amet " * (i + 2), "en", "s", 1) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    seen = _unique(Domain(spark, str(tmp_path)))
    assert seen.schema["first"].dataType.names == ["flag", "tid", "pos"] and seen.rdd.getNumPartitions() >= 96


def test_uniform_end_runs_from_short_to_long(spark):
    ends = [(0, 10, f, m, 0, w) for f, m, w in [(4, 5, 1.0), (4, 5, 2.0), (7, 5, 4.0), (4, 3, 7.0), (7, 3, 4.0), (10, 3, 1.0), (12, 5, 1.0), (12, 3, 1.0)]]
    got = bias.uniform_end_runs(spark.createDataFrame(ends, "tid long, tr_len long, frag_len long, mate int, pos long, w double"))
    want = [(3, 3, 6, 1.0), (3, 6, 9, 2.0), (3, 9, 10, 3.0), (5, 0, 4, 3 / 7 + 1.0), (5, 4, 7, 3 / 7)]
    assert sorted((r.mate, r.p, r.next, round(r.w, 9)) for r in got.collect()) == [(*edges, round(w, 9)) for *edges, w in want]


def test_uniform_sequence_bias_brute_force(spark):
    seqs_local = {0: "ACGTTGCANACGGT" * 3, 1: "TTGACCAGTA" * 4}
    seen = [(0, 30, 5), (0, 30, 3), (0, 22, 5), (1, 25, 3)]
    ends = spark.createDataFrame([(t, len(seqs_local[t]), f, m, 5, 1.0) for t, f, m in seen], "tid long, tr_len long, frag_len long, mate int, pos long, w double")
    seqs = spark.createDataFrame(list(seqs_local.items()), "tid long, seq string")
    got = {(r.mate, r.node, r.bpp, r.bp, r.b): r.weight for r in bias.seq_bias_uniform(ends, seqs).collect()}
    want = {}
    for t, length, mate in seen:
        s = seqs_local[t]
        rate = 1.0 / (len(s) - length + 1)
        for start in range(len(s) - length + 1):
            pos = start if mate == 5 else start + length
            lo = pos - 10 if mate == 5 else pos - 13
            win = "".join(s[i] if 0 <= i < len(s) else "N" for i in range(lo, lo + 23))
            win = win if mate == 5 else win[::-1]
            for node, depth in enumerate(bias.PARENTS):
                choose = [list("ACGT") if c == "N" else [c] for c in win[node : node + 3]]
                if depth < 2:
                    choose[0] = [""]
                if depth < 1:
                    choose[1] = [""]
                cells = [(a, b, c) for a in choose[0] for b in choose[1] for c in choose[2]]
                for cell in cells:
                    want[(mate, node, *cell)] = want.get((mate, node, *cell), 0.0) + rate / len(cells)
    assert got == pytest.approx(want)


def test_bias_sums_over_block_borders(spark):
    rng = np.random.default_rng(7)
    pos, ratio = rng.uniform(0.5, 2, (2, 5, bias.BINS)), rng.uniform(0.8, 1.25, (2, bias.NODES, 5, 5, 5))
    local = {i: "".join(rng.choice(list("ACGTNx"), n)) for i, n in enumerate((2 * bias.SPAN + 300, 2 * bias.SPAN, bias.SPAN + 1, 45, 1, 0))}
    seqs = spark.createDataFrame(list(local.items()), "tid long, seq string")

    def weight(seq, mate, at):
        code = ["ACGT".find(seq[i]) % 5 if 0 <= i < len(seq) else 4 for i in (range(at - 10, at + 13) if mate == 0 else range(at + 10, at - 13, -1))]
        group = sum(len(seq) >= limit for limit in bias.SIZE_LIMITS)
        value = pos[mate, group, min(at * 20 // len(seq), 19)] if len(seq) >= 20 else 1.0
        return value * np.prod([ratio[mate, k, code[k], code[k + 1], code[k + 2]] for k in range(bias.NODES)])

    both = {t: [np.array([weight(s, m, at) for at in range(len(s))]) for m in (0, 1)] for t, s in local.items()}
    wanted, want = [], {}
    for t, (five, three) in both.items():
        n = len(five)
        for length in sorted({0, 1, 30, bias.SPAN, bias.SPAN + 1, 2 * bias.SPAN - 5, n, n + 1} | {n - 3} - {-3, -2}):
            for kind in (0, 1, 2):
                wanted.append((t, kind, length))
                inside = five[: n - length + 1] if kind == 0 else three[length - 1 :] if kind == 1 else five[: n - length + 1] * three[length - 1 :] if 0 < length <= n else np.zeros(0)
                want[wanted[-1]] = 1.0 if length == 0 else inside.sum() if length <= n else 0.0
    got = bias.weight_norms(spark.createDataFrame(wanted, "tid long, _kind int, frag_len long"), seqs, pos, ratio).collect()
    assert len(got) == len(wanted)
    assert {(r["tid"], r["_kind"], r["frag_len"]): r["norm"] for r in got} == pytest.approx(want, rel=1e-9)

    mu, sigma = 4.0, 0.5
    norms = spark.createDataFrame([(t, len(s), 0.1) for t, s in local.items()], "tid long, length long, lnorm double")
    raw = {}
    for t, (five, three) in both.items():
        n = len(five)
        p = [np.exp(-(np.log(k) + np.log(sigma) + 0.918938533192 + ((np.log(k) - mu) / sigma) ** 2 / 2)) for k in range(1, n + 1)]
        value = np.exp(-0.1) * sum(p[k] * (five[: n - k] @ three[k:]) for k in range(n))
        raw[t] = value if value > 1 else n
    factor = sum(map(len, local.values())) / sum(raw.values())
    model = bias.BiasModel(pos, ratio, spark, seqs)
    out = {r.tid: r.eff_length for r in bias.effective_length_bias(None, seqs, model, norms, mu, sigma).collect()}
    assert out == pytest.approx({t: v * factor for t, v in raw.items()}, rel=1e-9)


def test_pair_sums_and_slices(spark):
    rng = np.random.default_rng(1)
    five, three = rng.random(37), rng.random(37)
    want = [sum(five[p] * three[p + k] for p in range(37 - k)) for k in range(37)]
    assert bias.pair_sums(five, three) == pytest.approx(want)
    from readweave.operators.blocks import add_slice

    s = "ACGT" * 300
    req = spark.createDataFrame([(0, -5), (0, 250), (0, 1195), (0, 3000)], "tid long, at int")
    got = dict(rows(add_slice(req, spark.createDataFrame([(0, s)], "tid long, seq string"), F.col("at"), F.lit(20), "x", 20), "at", "x"))
    padded = "N" * 5000 + s + "N" * 5000
    assert got == {a: padded[5000 + a : 5020 + a] for a in got}


@pytest.mark.parametrize("method", ["PR", "HS"])
def test_other_conjugate_rules_rise_too(spark, method):
    h = toy_hits(spark, n=80)
    fit = vb.vb_optimise(vb.prepare_hits(h), 12, method, max_iter=8)
    base = vb.vb_optimise(vb.prepare_hits(h), 12, "steepest", max_iter=8)
    assert all(b >= a - 1e-9 for a, b in zip(fit.bounds, fit.bounds[1:]))
    assert fit.bounds[-1] >= base.bounds[1]


def test_effective_length_of_long_transcripts(spark):
    mu, sigma, lengths = np.log(150_000.0), 0.02, [90, 149_000, 150_000, 150_700, 160_000]
    tr = spark.createDataFrame(list(enumerate(lengths)), "tid long, length long")
    table = scoring.length_table(spark, mu, sigma, max(lengths))
    norms = scoring.length_lognorm(tr, table, mu, sigma)
    got = {r.tid: r.eff_length for r in scoring.effective_length_uniform(tr, scoring.length_density(table, mu, sigma, max(lengths)), norms, 60).collect()}
    lnorm = {r.tid: r.lnorm for r in norms.collect()}
    for tid, n in enumerate(lengths):
        at = np.arange(1, n + 1.0)
        p = np.exp(-((np.log(at) - mu) ** 2) / (2 * sigma**2)) / (at * sigma * np.sqrt(2 * np.pi))
        want = float((p * (n - at)).sum() * np.exp(-lnorm[tid]))
        assert got[tid] == pytest.approx(want if want > 60 else n, rel=1e-6)


def test_pairs_of_unlike_mates_are_no_hits(spark):
    mate = lambda name: (name, 0, 1, "ACGT")
    rows = [(0, mate("a/1"), mate("a/2"), True), (1, mate("b/1"), mate("z/2"), True), (2, mate("c"), None, False)]
    df = spark.createDataFrame(rows, "k int, first struct<qname:string,flag:int,pos:int,seq:string>, second struct<qname:string,flag:int,pos:int,seq:string>, paired boolean")
    assert [r.k for r in df.filter(fragments.mates_differ()).collect()] == [1]


def test_resampling_survives_gaps(spark):
    s = spark.createDataFrame([(0, 1, n, float(n)) for n in (2, 5, 9, 40)], "file_idx int, tr long, n long, value double")
    got = samples.subsample(s, 7, 1).collect()
    assert len(got) == 7 and {r.value for r in got} <= {2.0, 5.0, 9.0, 40.0}
    two = s.unionByName(s.selectExpr("1 AS file_idx", "tr", "n", "value + 1 AS value"))
    r = samples.variance_sqdif(samples._numbered(two).drop("_size"), log=False).first()
    assert r["var"] == pytest.approx(0.5) and r["mean"] == pytest.approx(14.5)


def test_one_length_is_no_fit(spark):
    seen = spark.range(50).selectExpr("true AS paired", "200 AS frag_len")
    assert not scoring.frag_length_fit(seen).first()["valid"]


def test_header_of_any_length(spark, tmp_path):
    from readweave.sources.lines import read_header

    (tmp_path / "h").write_text("".join(f"# from file {i}\n" for i in range(500)) + "# T\n# M 7\n1 2\n# N 9\n")
    head = read_header(spark, str(tmp_path / "h"))
    assert head["M"] == 7 and "T" in head and "N" not in head


def test_stages_are_deleted(spark):
    import os

    from readweave.session import cut_lineage, discard

    df = cut_lineage(spark.range(3))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    discard(df)
    assert not os.path.isdir(folder)


@pytest.mark.parametrize("stop", [{"do_max": True}, {"scale_reduction": True}])
def test_stop_rules_of_chains(spark, stop):
    data = [(r, 1 + r % 3, 0.0) for r in range(30)]
    h = vb.prepare_hits(spark.createDataFrame(data, "read_id long, tr_id long, lprob double"))
    asked = []

    def reread():
        asked.append(1)
        return {"targetScaleReduction": "9"}

    settings = sampling.ChainSettings(chains=2, burn_in=0, samples_n=2, samples_save=4, samples_nmax=3)
    run = sampling.estimate_expression(h, 4, 5, False, settings, seed=3, reread=reread, **stop)
    assert len(asked) == 2 and run.samples_n in (2, 3)
    assert run.draws.select("n").distinct().count() == 2 and run.draws.select("chain").distinct().count() == 2


def test_pairing_by_cigar_in_batches():
    """A deletion skips reference, an insertion read; everything stops at the shorter text."""
    ref, cigar = pd.Series(["ACGTACGT", "ACGT", "AC", ""]), pd.Series(["2M2D3M", "1M2I2M", "5M", "3M"])
    texts, row, at = scoring.aligned_pieces(ref, cigar, pd.Series(["ACACG", "ATTCG", "ACGTA", "ACG"]), pd.Series(["abcde", "fghij", "klmno", "pqr"]))
    assert texts == [b"ACACG" + b"ACG" + b"AC", b"ACACG" + b"ACG" + b"AC", b"abcde" + b"fij" + b"kl"]
    assert row.tolist() == [0] * 5 + [1] * 3 + [2] * 2 and at.tolist() == [0, 1, 2, 3, 4, 0, 3, 4, 0, 1]


def test_noise_scores_each_alignment_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(i, i // 2, 1, -1.0 - i, -5.0 - i) for i in range(40)], "frag_seq long, read_id long, tr_id int, lprob double, low_lprob double")
    scored = rows.withColumn("lprob", F.udf(passed, "double").asNondeterministic()("lprob"))
    got = scoring.noise_alignment(scored).collect()
    assert seen.value == 40
    assert len(got) == 60 and sorted(r.lprob for r in got if r.tr_id == 0) == sorted(-6.0 - 2 * i for i in range(20))


def test_context_counts_make_no_row_per_node(spark):
    rows = [(5, "ACGTNACGTTACGATTACANNGC", 1.0), (3, "N" * 23, 2.0), (5, "ACGTNACGTTACGATTACANNGC", 0.5), (3, "G" * 22 + "T", 3.0), (3, None, 4.0)]
    want = {}
    for mate, win, w in rows:
        win = win or "N" * 23
        for node, depth in enumerate(bias.PARENTS):
            key = (mate, node, win[node] if depth >= 2 else "", win[node + 1] if depth >= 1 else "", win[node + 2])
            want[key] = want.get(key, 0.0) + w
    counted = bias._context_rows(spark.createDataFrame(rows, "mate int, win string, w double"))
    assert {tuple(r)[:5]: r.w for r in counted.collect()} == want
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_written(spark, monkeypatch):
    written, rows = vb.cut_lineage, []

    def watched(df):
        out = written(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(vb, "cut_lineage", watched)
    alphas = spark.range(401).select(F.col("id").alias("tr_id"), F.lit(2.0).alias("alpha"))
    assert vb.vb_samples(alphas, 60, 1).count() == 400 * 60
    assert sum(rows) <= 60 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_written_frames_leave_no_shuffle_files(spark):
    def left():
        tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(1 for f in tracker.getAllFiles().toString().split() if "shuffle_" in f)

    before, setting = left(), spark.conf.get(session.DROP_SHUFFLES, None)
    frame = session.cut_lineage(spark.range(1000).repartition(4, "id"))
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before and spark.conf.get(session.DROP_SHUFFLES, None) == setting
    assert frame.count() == 1000


def test_sam_lines_are_not_shuffled(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    lines = alignment_queries.sam_lines(d)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    head = d.doc_trs.count()
    got = [r["value"] for r in lines.collect()]
    assert "rangepartitioning(doc_id" in plan and "rangepartitioning(frag_seq" not in plan and "rangepartitioning(part" not in plan
    assert all(x.startswith("@SQ") for x in got[:head]) and not any(x.startswith("@") for x in got[head:])
    places = [(int(x.split("\t")[2][3:]), int(x.split("\t")[1]) & 128) for x in got[head:]]
    assert [p[0] for p in places] == sorted(p[0] for p in places)

"""The programs chained end to end on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from readweave.operators import samples as smp
from readweave.operators import sampling
from readweave.plans import programs
from readweave.plans.alignment_queries import _sam
from readweave.plans.domain import Domain
from readweave.session import cut_lineage


@pytest.fixture(scope="module")
def domain(spark):
    return Domain(spark, "/root/testdata/sf0.001")


def test_alignment_to_abundance(spark, domain):
    records = cut_lineage(_sam(domain))
    totals = {}
    for uniform in (True, False):
        out = programs.compute_probs(records, domain.doc_trs, domain.seqs, uniform=uniform)
        hits = cut_lineage(out.hits)
        c = out.counts.first()
        assert hits.filter("tr_id = 0").count() == c.n_map == hits.select("read_id").distinct().count()
        assert hits.filter("lprob is null or isnan(lprob)").count() == 0
        lens = out.tr.agg(F.sum("length").alias("l"), F.sum("eff_length").alias("e"), F.min("eff_length").alias("m")).first()
        assert lens.m > 0
        if not uniform:
            assert lens.e == pytest.approx(lens.l, rel=1e-6)
        totals[uniform] = hits.count()
    m = domain.doc_trs.count() + 1
    alphas, phi, draws, fit = programs.variational(hits, domain.doc_trs, m, method="vbem", max_iter=2, samples=3)
    assert alphas.count() == m and draws.groupBy("n").agg(F.sum("value").alias("s")).filter("abs(s-1) > 1e-9").count() == 0
    assert phi.groupBy("read_id").agg(F.sum("phi").alias("s")).filter("abs(s-1) > 1e-9").count() == 0
    settings = sampling.ChainSettings(chains=2, burn_in=1, samples_n=2, samples_save=2, samples_nmax=2)
    merged, run = programs.mcmc(hits, out.tr, m, 1, output_type="tau", settings=settings, seed=1)
    assert merged.select("n").distinct().count() == 2  # samples_save is the total over chains
    assert merged.groupBy("n").agg(F.sum("value").alias("s")).filter("abs(s-1) > 1e-9").count() == 0


def test_samples_to_report(spark, domain):
    means = smp.variance_sample(domain.series).select("tr", "mean")
    assert means.count() == 10
    report, cond, draws = programs.estimate_de(domain.samples, domain.curve, seed=4)
    assert report.filter("pplr < 0 or pplr > 1 or ci_low > ci_high").count() == 0
    again, _, _ = programs.estimate_de(domain.samples.repartition(3), domain.curve, seed=4)
    a, b = ({r.tr: r.pplr for r in x.collect()} for x in (report, again))
    assert a == b

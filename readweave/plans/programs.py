"""The command-line programs as functions over DataFrames."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.operators import bias, contrasts, expression, fragments, hyper, sampling, scoring
from readweave.operators import samples as smp
from readweave.operators import variational as vb
from readweave.session import cut_lineage


@dataclass
class Alignments:
    """Scored reads (read_id, tr_id, lprob), transcripts with effective lengths, counters, failed names."""

    hits: DataFrame
    tr: DataFrame
    counts: DataFrame
    failed: DataFrame


def compute_probs(
    records: DataFrame, tr: DataFrame, seqs: DataFrame, *, uniform: bool = True, length: tuple[float, float] | None = None,
    limit: int | None = None, unstranded: bool = False, exclude_singletons: bool = False, noise_mismatches: int = scoring.NOISE_MISMATCHES,
    mate_names_differ: bool = False, expression_prior: DataFrame | None = None, strict_strand: bool = False,
) -> Alignments:
    """Alignment records to read-by-transcript log-probabilities."""
    reads = cut_lineage(fragments.group_reads(fragments.pair_fragments(records)))
    summary = cut_lineage(fragments.read_summary(reads, mate_names_differ))
    if not mate_names_differ:
        fragments.check_mate_names(summary)
    m = tr.agg((F.max("tid") + 1).alias("m")).first()["m"]
    seen = cut_lineage(fragments.observe_unique(reads, summary, m, exclude_singletons))
    fit_row = scoring.frag_length_fit(seen, length).first()
    fit = (fit_row["mu"], fit_row["sigma"]) if fit_row["valid"] else None
    bare = seen.filter((F.col("first.qual") == "*") | (F.col("paired") & (F.col("second.qual") == "*")))
    freq = cut_lineage(scoring.mismatch_freq(scoring.with_reference(scoring.mates_of(bare), seqs)))
    model = None
    if not uniform:
        model = bias.BiasModel.fit(cut_lineage(bias.end_observations(seen, tr, expression_prior, unstranded, strict_strand)), seqs)
    kept = reads.join(fragments.ignored_reads(summary, limit, exclude_singletons), "read_id", "left_anti")
    mapped = F.col("first.flag").bitwiseAND(F.lit(4)) == 0
    whole = F.col("paired") | (F.col("first.flag").bitwiseAND(F.lit(1)) == 0)
    alike = F.lit(True) if mate_names_differ else ~fragments.mates_differ()
    good = kept.filter(mapped & whole & alike) if exclude_singletons else kept.filter(mapped & alike)
    scored = cut_lineage(scoring.score_fragments(good, tr, seqs, fit, freq, noise_mismatches, model, unstranded, strict_strand))
    # a read left with nothing but pairs of unlike names keeps a lone noise hit
    unlike = kept.filter(mapped & ~alike).select("read_id").distinct().join(scored.select("read_id").distinct(), "read_id", "left_anti")
    lone = unlike.select("read_id", F.lit(0).alias("tr_id"), F.lit(0.0).alias("lprob"))
    hits = scoring.noise_alignment(scored).unionByName(lone)
    failed = kept.join(scored.filter("lprob is not null"), "read_id", "left_anti")
    failed = failed.select(F.explode(F.array_compact(F.array("first.qname", "second.qname"))).alias("name")).distinct()
    lens = effective_lengths(tr, seqs, seen, fit, model)
    lengthened = tr.drop("eff_length").join(lens, "tid")
    return Alignments(hits, lengthened, fragments.read_counts(summary, limit, exclude_singletons), failed)


def effective_lengths(tr: DataFrame, seqs: DataFrame, seen: DataFrame, fit, model=None) -> DataFrame:
    """tid, eff_length; values that are not positive fall back to the length."""
    if fit is None:
        single = seen.agg(F.max("frag_len").alias("l")).first()["l"] or 0
        raw = scoring.effective_length_single_end(tr, single)
    else:
        longest = tr.agg(F.max("length").alias("l")).first()["l"]
        table = scoring.length_table(tr.sparkSession, *fit, longest)
        norms = scoring.length_lognorm(tr, table, *fit)
        if model is None:
            shortest = seen.agg(F.min("frag_len").alias("l")).first()["l"] or 0
            raw = scoring.effective_length_uniform(tr, scoring.length_density(table, *fit, longest), norms, shortest)
        else:
            raw = bias.effective_length_bias(tr, seqs, model, norms, *fit)
    j = tr.select("tid", "length").join(raw, "tid")
    return j.select("tid", F.when(F.col("eff_length") > 0, F.col("eff_length")).otherwise(F.col("length").cast("double")).alias("eff_length"))


def mcmc(hits: DataFrame, tr: DataFrame, m: int, n_unmapped: int, *, output_type: str = "rpkm", gibbs: bool = False, settings=None, seed: int = 0, **stop):
    """Abundance samples by Markov chains in the wanted unit (rpkm if it is unknown), and the run's diagnostics."""
    if output_type not in smp.UNITS:
        warnings.warn(f"unknown output unit {output_type}, using rpkm", stacklevel=2)
        output_type = "rpkm"
    prepared = vb.prepare_hits(hits)
    run = sampling.estimate_expression(prepared, m, n_unmapped, not gibbs, settings or sampling.ChainSettings(), seed, **stop)
    theta = run.draws.select(F.col("chain").alias("file_idx"), "tr", "n", F.col("theta").alias("value"))
    merged = smp.merge_files(smp.output_units(theta, output_type, tr, prepared.n_reads))
    prepared.unpersist()
    return merged, run


def variational(hits: DataFrame, tr: DataFrame, m: int, *, method: str = "FR", max_iter: int = 10_000, tol: float = 1e-5, samples: int = 0, output_type: str = "theta", seed: int = 0):
    """Posterior alphas, read assignments and optional samples."""
    prepared = vb.prepare_hits(hits)
    fit = vb.vb_optimise(prepared, m, method, max_iter, tol, tol)
    alphas = cut_lineage(vb.vb_alphas(fit.state))
    phi = cut_lineage(vb.vb_phi(prepared, fit.state))
    draws = vb.vb_samples(alphas, samples, seed, output_type, tr, prepared.n_reads) if samples else None
    prepared.unpersist()
    return alphas, phi, draws, fit


def estimate_de(samples: DataFrame, params: DataFrame, *, lambda0: float = 2.0, cf: float = 95.0, logged: bool = False, norm: list[float] | None = None, seed: int = 0):
    """Report per pair of conditions, condition means and the draws behind them."""
    x = smp.apply_norm(samples, norm) if norm else samples
    prior = expression.de_prior(x, params, logged)
    draws = cut_lineage(expression.de_samples(expression.de_posterior(x, prior, lambda0, logged), seed, lambda0))
    report = expression.de_pplr(draws).join(expression.de_fold_change(draws, cf), ["tr", "cond_a", "cond_b"])
    return report, expression.de_means(draws), draws


def smooth_only(params: DataFrame, f: float = 0.2, steps: int = 5, force: bool = True) -> DataFrame:
    return hyper.smooth_params(params, f, steps, force)


pplr = contrasts.pplr
fold_change = contrasts.fold_change
hyperparams = hyper.hyperparams

"""URL filter: rules first, then a ratio of character language models.

A rule has a host and the beginning of a path; it fits its host and all subdomains. Of the rules that fit, the longest wins,
of two as long the blocking one.

URLs that no rule fits are judged by two smoothed Markov models of variable order, one for accepted and one for rejected
URLs: a character's probability given the ``ORDER`` characters before it is its share after them, drawn towards the
probability given one character less, and so on down to even shares. The score is the difference of the log-likelihoods by
character. The models learn from the URLs that rules decide, or from any given list of URLs with verdicts. Counts are
taken over all of them, in tables of fixed size that contexts are hashed into: each task counts for itself, then tables are
added up, and the driver gets no more than their fixed size. A quarter of these URLs, by hash, only calibrates the
threshold: the one with the least mean of both error rates, from a histogram of scores; of several the highest.

Null URLs and URLs without ``://`` have an empty host and path and are scored as an empty string (score 0). Without
examples of both verdicts all scores are 0 and all URLs pass. Repeated URLs count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from readweave.llm.common import raw, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the given rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER, SLOTS, PULL = 5, 1 << 15, 2.0
BINS, SPAN = 4000, 8.0
CALIBRATE = 4


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """A struct of the rule that decides and its verdict; null if none fits. For lists of rules that fit into a query."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _contexts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For orders 0, 1, ...: slots of the contexts and of contexts with their next character; last, each character's text."""
    gap = bytes(ORDER)
    joined = np.frombuffer(gap.join([b"", *texts]), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + ORDER)
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(sizes.sum()) + np.repeat(ends - sizes - np.cumsum(sizes) + sizes, sizes)
    h = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:
            h = (h + joined[at - k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        both = (h + (joined[at] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(40)).astype(np.int64) % SLOTS + 2 * k * SLOTS, (both >> np.uint64(40)).astype(np.int64) % SLOTS + (2 * k + 1) * SLOTS, of


TABLE = 2 * (ORDER + 1) * SLOTS


def count(texts: list[bytes]) -> np.ndarray:
    total = np.zeros(TABLE, np.int64)
    for context, both, _ in _contexts(texts):
        total += np.bincount(context, minlength=TABLE) + np.bincount(both, minlength=TABLE)
    return total


def log_likelihood(counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Mean log-probability of a text's characters; 0 for empty texts."""
    p, of = 1 / 256, np.zeros(0, np.int64)
    for context, both, of in _contexts(texts):
        p = (counts[both] + PULL * p) / (np.maximum(counts[context], counts[both]) + PULL)
    return np.bincount(of, np.log(p), len(texts)) / np.maximum(1, [len(t) for t in texts])


@dataclass
class UrlModel:
    accepted: np.ndarray
    rejected: np.ndarray
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Above the threshold: rejected."""
        if not self.rejected.any() or not self.accepted.any():
            return np.zeros(len(texts))
        return log_likelihood(self.rejected, texts) - log_likelihood(self.accepted, texts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, TABLE), np.int64)
    for batch in batches:
        bad = batch.column("bad").to_numpy(zero_copy_only=False)
        texts = [t.as_py() for t in batch.column("text")]
        for k in (0, 1):
            own = [t for t, b in zip(texts, bad, strict=True) if b == k]
            if own:
                totals[k] += count(own)
    used = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])], ["slot", "accepted", "rejected"])


def scorer(spark: SparkSession, model: UrlModel):
    """A function of a text column that gives scores."""
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.scores([t.as_py() or b"" for t in batch]), pa.float64())

    return lambda text: F.arrow_udf(score, DoubleType()).asNondeterministic()(raw(text))


def fitted(examples: DataFrame) -> UrlModel:
    """A model from ``text`` and ``verdict`` (allow or block), all rows."""
    spark = examples.sparkSession
    known = examples.filter("text IS NOT NULL AND text <> ''").select("text", (F.col("verdict") == "block").alias("bad"))
    calibrates = F.pmod(F.xxhash64("text"), F.lit(CALIBRATE)) == 0
    counted = known.filter(~calibrates).select(raw(F.col("text")).alias("text"), "bad").mapInArrow(_counted, "slot bigint, accepted bigint, rejected bigint")
    added = counted.groupBy("slot").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).toArrow()
    tables = np.zeros((2, TABLE), np.int64)
    for k, name in enumerate(("accepted", "rejected")):
        tables[k][added["slot"].to_numpy()] = added[name].to_numpy()
    model = UrlModel(*tables, 0.0)
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS))).cast("int")
    scored = known.filter(calibrates).select("bad", scorer(spark, model)(F.col("text")).alias("score"))
    seen = np.zeros((2, BINS))
    for bad, b, n in scored.groupBy("bad", bin_.alias("bin")).count().collect():
        seen[int(bad), b] = n
    if seen.any(axis=1).all():
        share = seen / seen.sum(axis=1, keepdims=True)
        errors = np.cumsum(share[1]) + 1 - np.cumsum(share[0])
        best = np.flatnonzero(errors <= errors.min() + 1e-12)[-1]
        model.threshold = float((best + 1) / BINS * 2 * SPAN - SPAN)
    return model


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (``page_id``, ``url``) with ``host, path, rule, verdict`` and the models' ``score`` (null where a rule decides)."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    model = fitted(parsed.filter("by IS NOT NULL").select("text", "by.verdict"))
    score = scorer(pages.sparkSession, model)(F.when(F.col("by").isNull(), F.col("text")))
    scored = parsed.withColumn("score", score)
    verdict = F.coalesce("by.verdict", F.when(F.col("score") > model.threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("by").isNull(), F.col("score")).alias("score"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"))

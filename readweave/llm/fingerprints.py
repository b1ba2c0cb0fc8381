"""Document fingerprints by consistent weighted sampling.

A text's terms are its pairs of neighbouring words (split at ASCII white space, case kept; a single word is a term of its
own), weighted by how often they occur. For each of ``SAMPLES`` samples every term draws, from its hash alone, r and c from
gamma distributions with shape 2 and b from [0, 1). A term of weight w stands at t = floor(ln(w) / r + b) with
ln(a) = ln(c) - r * (t - b) - r; the term with the least a wins, and the sample is the winner with its t. Two texts get the
same sample with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima of weights.

Draws come from a fixed pool of ``POOL`` triples, picked by a hash for each term and sample, so that a weight's whole
column of a is worked out once. Samples are kept as 16 bits, which adds at most 1 / 65536 to a likeness.

Texts without words have a fingerprint of zeros, alike to each other only. A null text is an empty text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from readweave.llm.common import table

SAMPLES = 64
POOL = 1 << 16
SEED = 20
#: Rows of a range of ids, and the number of ranges that the driver hears of at most. More rows than that make ranges longer.
RANGE_ROWS, RANGES = 512, 1 << 16
CACHED = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln(c) and b of each triple; an odd factor for each sample."""
    step = np.uint64(0x9E3779B97F4A7C15)
    u = (_mixed((np.arange(5 * POOL, dtype=np.uint64) + np.uint64(1 + SEED * 8 * POOL)) * step) >> np.uint64(11)).reshape(5, POOL)
    u = (u.astype(np.float64) + 0.5) * 2.0**-53
    odd = _mixed((np.arange(SAMPLES, dtype=np.uint64) + np.uint64(SEED)) * step) | np.uint64(1)
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4], odd


@lru_cache(maxsize=64)
def _column(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """ln(a) and t of each triple for a term of this weight."""
    r, c, b, _ = _pool()
    t = np.floor(math.log(weight) / r + b)
    return (c - r * (t - b) - r).astype(np.float32), t.astype(np.int64).astype(np.uint64)


def signature(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16-bit samples of distinct term hashes, sorted, with whole weights of 1 or more."""
    if not terms.size:
        return np.zeros(SAMPLES, ">u2")
    odd = _pool()[3]
    pick = ((terms[:, None] * odd[None, :]) >> np.uint64(48)).astype(np.int32)
    least = np.empty(pick.shape, np.float32)
    for w in np.unique(weights).tolist():
        rows = np.flatnonzero(weights == w)
        least[rows] = _column(w)[0][pick[rows]]
    won = least.argmin(axis=0)
    t = np.array([_column(int(w))[1][p] for w, p in zip(weights[won], pick[won, np.arange(SAMPLES)], strict=True)], np.uint64)
    return (_mixed(terms[won] + _mixed(t + odd)) >> np.uint64(48)).astype(">u2")


def terms_of(text: bytes, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a text's terms. known: hashes of words seen before, added to."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.array([known[w] for w in words], np.uint64)
    return np.unique(_mixed(h[:-1] * np.uint64(3) + h[1:]) if h.size > 1 else h, return_counts=True)


_KNOWN: dict[bytes, int] = {}


def of_text(text: bytes) -> np.ndarray:
    if len(_KNOWN) > CACHED:
        _KNOWN.clear()
    return signature(*terms_of(text, _KNOWN))


@F.arrow_udf(StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Fingerprints, as hexadecimal digits, of a column of texts as bytes."""
    return pa.array([of_text(t.as_py() or b"").tobytes().hex() for t in texts], pa.string())


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, doc_id, text), sorted; each waits for the one after it in its range. Guests close a range."""
    held = None
    for batch in batches:
        out: list[tuple] = []
        for part, guest, doc_id, text in zip(*batch.columns, strict=True):
            part, guest, doc_id, text = part.as_py(), guest.as_py(), doc_id.as_py(), text.as_py() or ""
            if doc_id is None:
                out.append(_row(None, text, of_text(text.encode()), "", None))
                continue
            if held is not None and held[0] != part:
                raise ValueError("a range has no end")
            if guest and held is None:
                continue
            own = of_text(text.encode())
            if held is not None:
                out.append(_row(*held[1:], text, own))
            held = None if guest else (part, doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, _TYPES, strict=True)], names=_NAMES)
    if held is not None:
        raise ValueError("a range has no end")


_NAMES = [c.split()[0] for c in EDITED.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _row(doc_id: int | None, text: str, own: np.ndarray, after: str, after_print: np.ndarray | None) -> tuple:
    n = len(text)
    new = (text[: n - n // 4] + after[: n // 4]).encode()
    other = of_text(new)
    near_next = 0.0 if after_print is None else float((own == after_print).mean())
    return doc_id, n, hashlib.sha256(new).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), float((own == other).mean()), near_next


def edited_documents(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (``doc_id``, ``text``): fingerprints of the text and of the text with its last quarter
    replaced by the beginning of the next document, ascending ids (after the last the first), with their likeness.

    Ids are cut into ranges; a range gets its rows, and the first row of the range after it, in one task by one shuffle of
    the texts, and holds two rows at a time. Rows with equal ids go by text. Rows with a null id have no next document:
    their last quarter is left out, and ``near_next`` is 0."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spread = F.pmod(F.xxhash64("text"), F.lit(max(1, n // RANGE_ROWS))).cast("int")
    if low is None:
        dealt = rows.select(spread.alias("part"), F.lit(False).alias("guest"), "doc_id", "text")
        return dealt.repartition("part").mapInArrow(_edited, EDITED)
    width = (high - low) // RANGES + 1
    cell = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("int")
    counts = ids.filter("doc_id IS NOT NULL").groupBy(cell.alias("cell")).agg(F.count("*"), F.min("doc_id")).collect()
    cells, heads, filled = [], [], RANGE_ROWS
    for c, many, first in sorted(tuple(r) for r in counts):
        if filled >= RANGE_ROWS:
            heads.append(first)
            filled = 0
        filled += many
        cells.append((c, len(heads) - 1))
    ranges = spark.createDataFrame([(c, p, heads[p], (p - 1) % len(heads)) for c, p in cells], "cell int, part int, head bigint, before int")
    placed = rows.withColumn("cell", cell).join(F.broadcast(ranges), "cell", "left")
    own = F.struct(F.coalesce("part", spread).alias("part"), F.lit(False).alias("guest"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(True).alias("guest"))
    dealt = placed.withColumn("to", F.explode(F.when(F.col("doc_id") == F.col("head"), F.array(own, ahead)).otherwise(F.array(own))))
    dealt = dealt.select("to.part", "to.guest", "doc_id", "text").repartition("part")
    return dealt.sortWithinPartitions(F.col("doc_id").isNotNull(), "part", "guest", "doc_id", "text").mapInArrow(_edited, EDITED)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))

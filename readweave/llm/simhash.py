"""SimHash near-duplicates found by anchor-point covering.

Two 64-bit fingerprints within 4 bits differ, on two of three blocks of 21, 21 and 22 bits, by 2 bits together at most, as
the third block holds at least a third of the difference. So for each of the three pairs of blocks a covering code of the
42 or 43 bits gives anchors: the product of the binary Golay code (23 bits, covering radius 3), the Hamming code (15 bits,
radius 1) and all words of the bits left (radius 0). A fingerprint is copied to each anchor that lies within the covering
radius of some point within half the pair's threshold of it. That is the part of the anchors within radius plus threshold
that pairs need: of two fingerprints 2 bits apart, the point half-way is within 1 of both, and its anchor gets both. Some
17 anchors of 2**28 for a pair of blocks keep copies few and chance meetings rare at any input size.

Fingerprints are compared at their anchors and linked at ``BITS`` or fewer differing bits. Equal fingerprints were made one
before, so a group of exact copies is one fingerprint. An anchor with many fingerprints is cut into tiles, and each pair of
tiles is a piece of work of its own; what it puts out is a star for each connected part, not all pairs. Nothing is capped.

Null texts, empty texts and texts of white space have fingerprint zero and are linked like any others. Rows with a null id
are members without being the smallest; a group of such rows only has a null component. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from readweave.llm.common import LOWER, fresh, raw, row_key, table
from readweave.llm.components import roots
from readweave.session import cut_lineage, discard

BITS = 4
SHINGLE = 4
SEED = 42
BLOCKS = (21, 21, 22)
TILE = 2048
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned SimHash of the lower-case 4-word shingles, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(line)]))
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, SHINGLES_AT_ONCE):
        part = [digest(line[a:b], SEED) for a, b in zip(starts[i : i + SHINGLES_AT_ONCE], ends[i : i + SHINGLES_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error of at most 3 bits for each remainder."""

    def remainder(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GOLAY << (k - 11)
        return word

    error = np.zeros(1 << 11, np.int64)
    for n in (1, 2, 3):
        for at in combinations(range(23), n):
            word = sum(1 << i for i in at)
            error[remainder(word)] = word
    return np.array([remainder(w) for w in range(1 << 12)]), np.array([remainder(w << 12) for w in range(1 << 11)]), error


def nearest_golay(words: np.ndarray) -> np.ndarray:
    low, high, error = _golay()
    return words ^ error[low[words & 0xFFF] ^ high[words >> 12]]


@cache
def _hamming() -> np.ndarray:
    """The codeword nearest to each 15-bit word: the exclusive or of its set positions names the position to flip."""
    words = np.arange(1 << 15)
    wrong = np.zeros_like(words)
    for k in range(15):
        wrong ^= (words >> k & 1) * (k + 1)
    return np.where(wrong > 0, words ^ (1 << np.maximum(wrong, 1) - 1), words)


def anchors(prints: np.ndarray) -> np.ndarray:
    """Anchor numbers of unsigned fingerprints, a row for each, with repeats."""
    cut = np.cumsum((0, *BLOCKS))
    block = [(prints >> np.uint64(cut[i]) & np.uint64((1 << BLOCKS[i]) - 1)).astype(np.int64) for i in range(3)]
    out = []
    for left_out in range(3):
        one, two = (i for i in range(3) if i != left_out)
        word = block[one] | block[two] << BLOCKS[one]
        size = BLOCKS[one] + BLOCKS[two]
        near = np.concatenate([word[:, None], word[:, None] ^ (1 << np.arange(size))[None, :]], axis=1)
        code = nearest_golay(near & 0x7FFFFF) | _hamming()[near >> 23 & 0x7FFF] << 23 | near >> 38 << 38
        out.append(code | left_out << 43)
    return np.concatenate(out, axis=1)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for i in range(0, len(prints), 10_000):
            part = prints[i : i + 10_000]
            codes = np.sort(anchors(part.view(np.uint64)), axis=1)
            first = np.ones(codes.shape, bool)
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(np.repeat(part, first.sum(axis=1)))], ["anchor", "fp"])


def stars(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member and first member of each connected part of some unsigned fingerprints, first members left out."""
    left, members, firsts = prints, [], []
    while left.size > 1:
        first, left = left[0], left[1:]
        ahead = [np.array([first])]
        while ahead and left.size:
            for x in ahead.pop():
                close = np.bitwise_count(left ^ x) <= BITS
                if close.any():
                    found, left = left[close], left[~close]
                    members.append(found)
                    firsts.append(np.full(found.size, first))
                    ahead.append(found)
                    if not left.size:
                        break
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *members]), np.concatenate([none, *firsts])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by group. Groups are short; one that a batch cuts is carried over to the next batch."""
    rest = np.zeros((4, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        if new.size:
            yield _links(rows[3, : new[-1]].view(np.uint64), np.concatenate(([0], new)))
            rest = rows[:, new[-1] :]
        else:
            rest = rows
    yield _links(np.ascontiguousarray(rest[3]).view(np.uint64), np.array([0, rest.shape[1]]))


def _links(prints: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    starts, sizes = bounds[:-1], np.diff(bounds)
    two = starts[sizes == 2]
    near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= BITS]
    found = [(prints[near], prints[near + 1])]
    found += [stars(prints[s : s + n]) for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True)]
    a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: enough links between the distinct fingerprints ``fp`` to join all that are connected at ``BITS`` bits."""
    copied = prints.select("fp").mapInArrow(_copies, "anchor bigint, fp bigint")
    shared = copied.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    # merged by decree: Spark takes the copies to be as small as the fingerprints they are made of, and would broadcast them
    met = copied.join(shared.hint("merge"), "anchor").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    met = met.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pieces = met.select("anchor", F.least("tile", "other").cast("bigint").alias("i"), F.greatest("tile", "other").cast("bigint").alias("j"), "fp")
    dealt = pieces.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    return dealt.mapInArrow(_compared, "a bigint, b bigint")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """``row, doc_id, fp, component_id, stays`` of a written table ``row, doc_id, fp``. ``stays`` marks one row of each
    component, one with the smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = cut_lineage(rows.groupBy("fp").agg(first))
    root = roots(links(classes))
    linked = cut_lineage(classes.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    whole = linked.groupBy("root").agg(F.min("first").alias("first"))
    of = cut_lineage(linked.select("fp", "root").join(whole, "root").select("fp", "first"))
    discard(classes, linked)
    return rows.join(of, "fp").select("row", "doc_id", "fp", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("stays"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one left of each group of near-duplicates."""
    row = fresh("row", docs.columns)
    kept = cut_lineage(row_key(docs, row))
    rows = cut_lineage(kept.select(F.col(row).alias("row"), "doc_id", fingerprints(raw(F.col("text"))).alias("fp")))
    stay = near_duplicates(rows).filter("stays").select(F.col("row").alias(row))
    return kept.join(stay, row, "left_semi").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fingerprints(raw(F.col("text"))).alias("fp"))
    near = near_duplicates(cut_lineage(row_key(docs, "row")))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Masked pseudo-likelihood: a bidirectional window network predicts each token from both sides.

Tokens are lower-case words (split at ASCII white space), hashed into ``BUCKETS`` numbers; numbers are cut by frequency into
``CLASSES`` classes of about equal mass. A token's probability is that of its class, given the classes of the ``SIDE`` tokens
on either side, times the token's share of its class. The network has a table for each of the places around, added up to
a hidden layer, and a softmax over classes. A document's score is the sum of the log-probabilities of all its tokens.

Counts are taken over all documents: each task counts for itself, the numbers' sums come to the driver, ``BUCKETS`` rows at
most. Training reads all documents in ``ROUNDS`` rounds: in each, every task begins with the shared parameters and trains on
all tokens of its own documents, some tens of thousands of bytes at a time, in ``STEP`` passes over them: pass k takes the tokens at
places k, k + ``STEP``, ... of every document, so a step's tokens lie apart. So each round predicts each token of each document
once; parameters are then averaged by tokens seen, by a grouped sum in Spark. What is gathered grows with the input, and what reaches the driver is of fixed size.

Texts are split once: their numbers are written, two bytes a token, and counting, training and scoring read those.

Null texts, empty texts and texts of white space have no tokens: sum 0, mean null. Repeated rows count as often as they
occur. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from readweave.llm.common import LOWER, fresh, raw, table
from readweave.session import cut_lineage, discard

BUCKETS, CLASSES, SIDE, HIDDEN = 1 << 16, 64, 2, 32
ROUNDS, BATCH, RATE, SEED = 2, 512, 0.1, 11
#: A pass trains on each ``STEP``-th token, so as many passes reach every token once; every round makes them all.
STEP = ROUNDS
#: Holds every number below ``BUCKETS``.
NUMBER = np.dtype("<u2")
AT_ONCE = 1 << 14
CACHED = 200_000
SHAPES = {"near": (2 * SIDE, CLASSES + 1, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "out_bias": (CLASSES,)}
N_PARAMETERS = sum(int(np.prod(s)) for s in SHAPES.values())


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word, SEED) % BUCKETS
        return n


_NUMBERS = _Numbers()


def tokens(text: bytes | None) -> np.ndarray:
    words = (text or b"").translate(LOWER).split()
    return np.fromiter(map(_NUMBERS.__getitem__, words), np.int32, len(words))


@dataclass
class Vocabulary:
    """Class of each number, and the logarithm of its share of the class."""

    classes: np.ndarray
    shares: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        mass = counts + 1.0  # numbers not seen yet count as seen once
        order = np.argsort(-mass, kind="stable")
        before = np.cumsum(mass[order]) - mass[order]
        classes = np.empty(BUCKETS, np.uint8)
        classes[order] = np.minimum(before / mass.sum() * CLASSES, CLASSES - 1).astype(np.uint8)
        total = np.bincount(classes, mass, CLASSES)
        return Vocabulary(classes, np.log(mass / total[classes]).astype(np.float32))


def parameters(flat: np.ndarray) -> dict[str, np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])[:-1]
    return {k: part.reshape(s) for (k, s), part in zip(SHAPES.items(), np.split(flat, cuts), strict=True)}


def first_parameters(counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    flat = np.zeros(N_PARAMETERS, np.float32)
    p = parameters(flat)
    p["near"][:] = rng.standard_normal(p["near"].shape) * 0.3
    p["out"][:] = rng.standard_normal(p["out"].shape) * 0.1
    total = np.bincount(vocabulary.classes, counts + 1.0, CLASSES)
    p["out_bias"][:] = np.log((total + 1) / (total + 1).sum())
    return flat


def _around(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes of the tokens around some places of a padded sequence, a column for each place around."""
    return np.stack([classes[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def _layers(p: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer, and what the softmax takes, the greatest being 0."""
    hidden = p["bias"] + sum(p["near"][i][around[i]] for i in range(2 * SIDE))
    np.maximum(hidden, 0, out=hidden)
    z = hidden @ p["out"]
    z += p["out_bias"]
    z -= z.max(axis=1, keepdims=True)
    return hidden, z


def _forward(p: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and log-probabilities of all classes."""
    hidden, z = _layers(p, around)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return hidden, z


def _padded(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one sequence with pads between, the places of tokens, and the text of each."""
    pad = np.full(SIDE, CLASSES, np.uint8)
    joined = np.concatenate([x for c in classes for x in (pad, c)] + [pad])
    sizes = np.array([len(c) for c in classes], np.int64)
    of = np.repeat(np.arange(len(classes)), sizes)
    at = np.arange(sizes.sum()) + SIDE * (of + 1)
    return joined, at, of


def train(flat: np.ndarray, squares: np.ndarray, classes: list[np.ndarray], turn: int) -> int:
    """Adagrad steps, in place, on each ``STEP``-th token; the number of tokens seen."""
    joined, passes = _passes(classes)
    return _steps(flat, squares, joined, passes[turn % STEP])


def _passes(classes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts in one sequence, and the places of each pass; together they are all tokens."""
    joined, at, of = _padded(classes)
    nth = (np.arange(len(at)) - np.searchsorted(of, of)) % STEP
    return joined, [at[nth == turn] for turn in range(STEP)]


def _steps(flat: np.ndarray, squares: np.ndarray, joined: np.ndarray, at: np.ndarray) -> int:
    p, g2 = parameters(flat), parameters(squares)
    for i in range(0, len(at), BATCH):
        here = at[i : i + BATCH]
        around, true = _around(joined, here), joined[here]
        hidden, dz = _layers(p, around)
        np.exp(dz, out=dz)
        dz /= dz.sum(axis=1, keepdims=True)
        dz[np.arange(len(here)), true] -= 1
        dz /= len(here)
        dh = (dz @ p["out"].T) * (hidden > 0)
        grad = {"out": hidden.T @ dz, "out_bias": dz.sum(axis=0), "bias": dh.sum(axis=0), "near": np.zeros(SHAPES["near"], np.float32)}
        for k in range(2 * SIDE):
            one = np.zeros((CLASSES + 1, len(here)), np.float32)
            one[around[k], np.arange(len(here))] = 1
            grad["near"][k] = one @ dh
        for k, g in grad.items():
            g2[k] += g * g
            p[k] -= RATE * g / (np.sqrt(g2[k]) + 1e-4)
    return len(at)


@dataclass
class LanguageModel:
    vocabulary: Vocabulary
    flat: np.ndarray

    def scores(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens, and sums of their log-probabilities, of texts as tokens."""
        joined, at, of = _padded([self.vocabulary.classes[n] for n in numbers])
        share = self.vocabulary.shares[np.concatenate(numbers)] if len(at) else np.zeros(0, np.float32)
        p, total = parameters(self.flat), np.zeros(len(numbers))
        for i in range(0, len(at), AT_ONCE):
            here = at[i : i + AT_ONCE]
            z = _layers(p, _around(joined, here))[1]
            own = z[np.arange(len(here)), joined[here]]
            np.exp(z, out=z)
            total += np.bincount(of[i : i + AT_ONCE], own - np.log(z.sum(axis=1)) + share[i : i + AT_ONCE], len(numbers))
        return np.bincount(of, minlength=len(numbers)), total


@F.arrow_udf(BinaryType())
def _written(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts as the numbers of their tokens, two bytes each."""
    for batch in batches:
        yield pa.array([tokens(t.as_py()).astype(NUMBER).tobytes() for t in batch], pa.binary())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for group in _groups(*batch.columns):
            total += np.bincount(np.concatenate(group), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["number", "n"])


def _groups(written: pa.Array, sizes: pa.Array) -> Iterator[list[np.ndarray]]:
    """Texts of a batch as tokens, some tens of thousands of bytes of text at a time."""
    group, size = [], 0
    for t, n in zip(written, sizes.to_pylist(), strict=True):
        group.append(np.frombuffer(t.as_py(), NUMBER))
        size += n
        if size > 200_000:
            yield group
            group, size = [], 0
    if group:
        yield group


def _numbered(docs: DataFrame, keep: list[str], text: Column, written: str, size: str) -> DataFrame:
    """Columns of ``docs`` with the tokens of a column of bytes and its size, on disk."""
    return cut_lineage(docs.select(*keep, _written(text).alias(written), F.coalesce(F.octet_length(text), F.lit(0)).alias(size)))


def fitted(texts: DataFrame) -> LanguageModel | None:
    """A model from all rows of ``texts``, a column of bytes; none if there are no tokens."""
    numbered = _numbered(texts, [], F.col(texts.columns[0]), "written", "size")
    model = _fitted(numbered)
    discard(numbered)
    return model


def _fitted(numbered: DataFrame) -> LanguageModel | None:
    """The same from tokens and sizes, which are read in each round."""
    spark = numbered.sparkSession
    counted = numbered.mapInArrow(_counts, "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[counted["number"].to_numpy()] = counted["n"].to_numpy()
    if not counts.any():
        return None
    vocabulary = Vocabulary.of(counts)
    flat = first_parameters(counts, vocabulary)
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((vocabulary, flat))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, own = sent.value
            own, squares, seen = own.copy(), np.zeros(N_PARAMETERS, np.float32), 0
            for batch in batches:
                for group in _groups(*batch.columns):
                    joined, passes = _passes([words.classes[t] for t in group])
                    seen += sum(_steps(own, squares, joined, at) for at in passes)
            weighted = own.astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_PARAMETERS)), pa.array(weighted), pa.array(np.full(N_PARAMETERS, seen))], ["k", "value", "seen"])

        added = numbered.mapInArrow(learn, "k bigint, value double, seen bigint").groupBy("k").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")).toArrow()
        if added["seen"].to_numpy().max(initial=0) > 0:
            new = np.empty(N_PARAMETERS, np.float32)
            new[added["k"].to_numpy()] = added["value"].to_numpy() / added["seen"].to_numpy()
            flat = new
    return LanguageModel(vocabulary, flat)


SCORED = "struct<n_tokens:bigint,log_likelihood:double>"


def scored(docs: DataFrame, out: str = "lm", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ``out`` of the number of tokens and the sum of their log-probabilities, by a model of all of
    ``docs``. An older column of that name is replaced. ``keep``: the columns of ``docs`` that are needed, if not all."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    written, size = (fresh(label, docs.columns) for label in ("written", "size"))
    numbered = _numbered(docs, kept, raw(F.col(text_col)), written, size)
    sent = docs.sparkSession.sparkContext.broadcast(_fitted(numbered.select(written, size)))

    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
            for group in _groups(*columns):
                a, b = sent.value.scores(group) if sent.value else (np.zeros(len(group), np.int64), np.zeros(len(group)))
                n.append(a)
                total.append(b)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(total))], ["n_tokens", "log_likelihood"])

    found = F.arrow_udf(score, SCORED).asNondeterministic()(F.col(written), F.col(size))
    return numbered.withColumn(out, found).drop(written, size)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, keep=["doc_id"]).select("doc_id", "lm.*")
    return out.withColumn("mean", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))

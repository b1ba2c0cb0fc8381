"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and read by filters of ``WIDTH`` bytes, ``STRIDE`` bytes apart, so that windows overlap and
cover the whole text. Within chunks of ``CHUNK`` windows each filter keeps its maximum; a document has, for each filter, the
maximum, the mean and the least of its chunks' maxima. (Where words repeat, few filters find what they look for, so
means and minima tell of monotony, maxima of single marks.) A hidden layer combines them into one probability.

Embedding, filters and layers are learned together by gradient descent on the logistic loss; only the windows that win a
chunk carry gradients. It learns from at most ``SAMPLE[k]`` rows labelled k, the first by a hash of the id, and at most
``SAMPLE_BYTES`` of text in total, with weights that restore the labels' true shares.

Null and empty texts are scored as one window of padding. Rows with null ids are scored and never learned from, null labels
are ignored. With labels of one kind only, or none, all scores are that kind's share (0.0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from readweave.llm.common import fresh, raw, table
from readweave.llm.labelled import fitted_on_sample

FOLDS, HELD = 3, 1
SAMPLE, SAMPLE_BYTES = {0: 1500, 1: 1500}, 16_000_000
EMBED, WIDTH, STRIDE, FILTERS, CHUNK, HIDDEN = 8, 12, 4, 48, 64, 16
EPOCHS, BATCH, RATE, SEED = 12, 24, 4e-3, 7
#: Bytes of text that are scored at once; longer texts are taken in parts that overlap by a window.
AT_ONCE = 1 << 19


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    share: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.array([_combine(self.weights, _pooled(self.weights, t))[-1] for t in texts], np.float64)))


def _windows(table_: np.ndarray, text: bytes) -> np.ndarray:
    """Embedded windows, a row for each. Texts are padded to whole windows."""
    size = max(0, -(-(len(text) - WIDTH) // STRIDE)) * STRIDE + WIDTH
    codes = np.zeros(size, np.uint8)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    steps = table_[codes].reshape(-1, STRIDE * EMBED)
    n = len(steps) - WIDTH // STRIDE + 1
    return np.lib.stride_tricks.as_strided(steps, (n, WIDTH * EMBED), steps.strides)


def _chunk_starts(n: int) -> np.ndarray:
    """Chunks of ``CHUNK`` windows; a rest of less than half a chunk goes with the chunk before it."""
    return np.arange(max(1, (n + CHUNK // 2) // CHUNK)) * CHUNK


def _pooled(w: dict[str, np.ndarray], text: bytes) -> np.ndarray:
    """Chunk maxima of all filters. A text is taken in parts of whole chunks, so memory is bounded."""
    out, part = [], AT_ONCE // (CHUNK * STRIDE) * CHUNK * STRIDE
    for at in range(0, max(1, len(text) - WIDTH + STRIDE), part):
        x = _windows(w["embed"], text[at : at + part + WIDTH - STRIDE])
        out.append(np.maximum.reduceat(x @ w["filters"], _chunk_starts(len(x)), axis=0))
    return np.maximum(np.concatenate(out) + w["bias"], 0)


def _combine(w: dict[str, np.ndarray], pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    features = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0), pooled.min(axis=0)])
    hidden = np.maximum(features @ w["mix"] + w["mix_bias"], 0)
    return features, hidden, float(hidden @ w["out"] + w["out_bias"][0])


def _gradient(w: dict[str, np.ndarray], text: bytes, label: int, grad: dict[str, np.ndarray], weight: float) -> None:
    codes = np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8)
    x = _windows(w["embed"], text)
    raw_ = x @ w["filters"]
    starts = _chunk_starts(len(x))
    ends = np.append(starts[1:], len(x))
    best = np.stack([raw_[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)])
    top = np.take_along_axis(raw_, best, axis=0) + w["bias"]
    pooled = np.maximum(top, 0)
    features, hidden, z = _combine(w, pooled)
    dz = weight * (1 / (1 + np.exp(-z)) - label)
    dh = dz * w["out"] * (hidden > 0)
    df = w["mix"] @ dh
    k, cols = FILTERS, np.arange(FILTERS)
    dp = np.repeat(df[None, k : 2 * k] / len(pooled), len(pooled), axis=0)
    dp[pooled.argmax(axis=0), cols] += df[:k]
    dp[pooled.argmin(axis=0), cols] += df[2 * k :]
    dp *= top > 0
    grad["out"] += dz * hidden
    grad["out_bias"] += dz
    grad["mix"] += np.outer(features, dh)
    grad["mix_bias"] += dh
    grad["bias"] += dp.sum(axis=0)
    won = x[best.ravel()].reshape(len(pooled), k, -1)
    grad["filters"] += np.einsum("ckd,ck->dk", won, dp)
    back = (dp.ravel()[:, None] * np.tile(w["filters"].T, (len(pooled), 1))).reshape(-1, EMBED)
    at = np.minimum(best.ravel()[:, None] * STRIDE + np.arange(WIDTH)[None, :], len(codes) - 1)
    code = codes[at].ravel()
    for d in range(EMBED):
        grad["embed"][:, d] += np.bincount(code, back[:, d], 256)


def train(texts: list[str], labels: list[int], share: float) -> Network:
    """share: the true share of label 1, of which the sample needn't be an image."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Network({}, float(share))
    coded = [t.encode() for t in texts]
    rng = np.random.default_rng(SEED)
    shape = {"embed": (256, EMBED), "filters": (WIDTH * EMBED, FILTERS), "bias": (FILTERS,), "mix": (3 * FILTERS, HIDDEN), "mix_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
    scale = {"embed": 0.5, "filters": (2 / WIDTH / EMBED) ** 0.5, "mix": (2 / 3 / FILTERS) ** 0.5, "out": HIDDEN**-0.5}
    w = {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shape.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    steps, total = 0, EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            for j in order[i : i + BATCH]:
                _gradient(w, coded[j], labels[j], grad, weight[j] / BATCH)
            steps += 1
            rate = RATE * min(1, steps / 40) * (1 - steps / (total + 1))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-6) + 1e-3 * w[k])
    return Network(w, float(share))


def scorer(spark: SparkSession, network: Network):
    """A function of a column of texts that gives scores; the network is of fixed size and sent to each executor once."""
    sent = spark.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sent.value.scores([t.as_py() or b""])[0] for t in batch], pa.float64())

    f = F.arrow_udf(score, DoubleType()).asNondeterministic()
    return lambda text: f(raw(text))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Network:
    return fitted_on_sample(docs, labels.filter(~held_out(F.col("doc_id"))), "quality", SAMPLE, SAMPLE_BYTES, train)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is a half or more."""
    score = fresh("score", docs.columns)
    scored = docs.withColumn(score, scorer(docs.sparkSession, fitted(docs, labels))(F.col("text")))
    return scored.filter(F.col(score) >= 0.5).select(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = fitted(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(spark, network)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Toxicity by a subsequence string kernel and a support vector machine over Nyström landmarks.

Kernel: two words (with a mark at either end) are alike by the triples of characters that they share in this order, not
necessarily side by side; a triple counts ``DECAY`` to the power of its length in each word, up to ``REACH`` characters. An
inserted character or a gap so lowers the likeness without ending it. Single characters set apart by blanks are read as one
word, words with signs in them also without, look-alike digits as letters.

Training: sentences of labelled documents carry the label of their document. A sentence stands for its most telling word,
first by document frequencies, then by the machine of the round before, as only some sentences of a toxic document are
toxic. Landmarks are the most telling words of both kinds; the machine is linear in the Nyström features. As these are
linear in the kernel, and the kernel is linear in triples, the machine is one table of weights of triples, of fixed size.

A document's score is a logistic function of its highest word margins and of how many words are beyond the margin, fitted on
the training documents with the label's true share. Every word of the whole text is scored; words longer than ``LONG``
are scored in overlapping windows.

It learns from at most ``SAMPLE[k]`` rows labelled k, the first by a hash of the id, and at most ``SAMPLE_BYTES`` of
text in total. Null and empty texts are scored like texts without any telling word. Rows with null ids are scored and never
learned from, null labels are ignored; a document labelled twice is learned from twice. With labels of one kind only, or
none, all scores are that kind's share (0.0 without labels).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from readweave.llm.common import fresh, table, unique
from readweave.llm.labelled import fitted_on_sample

FOLDS, HELD = 5, 0
SAMPLE, SAMPLE_BYTES = {0: 3000, 1: 1000}, 32_000_000
DECAY, REACH, LONG = 0.75, 6, 24
LANDMARKS, ROUNDS, MINED, SQUARED = 192, 3, 2000, 2
LEAST, CLEAR, MOST = -1.5, 0.5, 3.0
SURE = 0.7
LETTERS, BINS = 64, 509
CACHED = 400_000
EDGE = re.compile(r"^\W+|[\W_]+$")
SIGNS = re.compile(r"[\W_]")
APART = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
SENTENCE = re.compile(r"[.!?]+\s|\n+")
#: Look-alikes of letters.
ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def words_of(text: str) -> list[str]:
    """All words of a text in lower case, with runs of single characters also read as one word."""
    out = text.lower().split()
    return out + [re.sub(r"\s", "", m) for m in APART.findall(text.lower())]


def bare(word: str) -> str:
    return EDGE.sub("", word).translate(ALIKE)


def readings(word: str) -> list[str]:
    """A word as it stands and, if signs are put between its characters, without them; in pieces if long."""
    plain = bare(word)
    joined = SIGNS.sub("", plain)
    return [p for w in dict.fromkeys((plain, joined)) for p in pieces(w) if p]


def pieces(word: str) -> list[str]:
    return [word[i : i + LONG] for i in range(0, max(1, len(word) - LONG // 2), LONG // 2)]


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the triples of a word with n characters and marks."""
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + REACH)) for k in range(j + 1, min(n, i + REACH))]).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1.0)).astype(np.float32)


def _coded(words: list[str], n: int) -> np.ndarray:
    """Letters of words of length n with marks: a to z are 1 to 26, others share the rest, marks are 0."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
    letter = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (LETTERS - 27)).astype(np.int32)
    return np.pad(letter, ((0, 0), (1, 1)))


def _by_triple(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of words, their triples, weights of the triples, and norms of the words, for words of one length at a time.

    For the norm, triples are added up in ``BINS`` bins: repeats count together, and few others do."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at, weight = _triples(int(n) + 2)
        which = np.flatnonzero(lengths == n)
        step = max(1, 400_000 // max(BINS, len(at)))
        for i in range(0, len(which), step):
            part = which[i : i + step]
            c = _coded([words[j] for j in part], int(n))
            code = (c[:, at[:, 0]] * LETTERS + c[:, at[:, 1]]) * LETTERS + c[:, at[:, 2]]
            bins = np.arange(len(part))[:, None] * BINS + code * 31 % BINS
            total = np.bincount(bins.ravel(), np.tile(weight, len(part)), len(part) * BINS).reshape(-1, BINS)
            yield part, code, weight, np.sqrt(np.maximum(np.einsum("ij,ij->i", total, total), 1e-9)).astype(np.float32)


class Likeness:
    """Likeness of words to landmarks, squared ``SQUARED`` times: a kernel again, and one that fades faster with distance.

    Held by triple: which landmarks have it and with what weight."""

    def __init__(self, landmarks: list[str]) -> None:
        self.n = len(landmarks)
        found = [(np.repeat(part, code.shape[1]), code.ravel(), (weight / norm[:, None]).ravel()) for part, code, weight, norm in _by_triple(landmarks)]
        mark, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        pair, at = np.unique(code.astype(np.int64) * self.n + mark, return_inverse=True)
        self.mark, self.weight = (pair % self.n).astype(np.int32), np.bincount(at, weight).astype(np.float32)
        used, first = np.unique(pair // self.n, return_index=True)
        self.place = np.zeros(LETTERS**3, np.int32)
        self.place[used] = np.arange(1, len(used) + 1)
        self.first = np.concatenate(([0], first, [len(pair)]))

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.n), np.float32)
        for part, code, weight, norm in _by_triple(words):
            row = self.place[code].ravel()
            known = row.nonzero()[0]
            row = row[known]
            many = self.first[row + 1] - self.first[row]
            at = np.repeat(self.first[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
            word = np.repeat(known // code.shape[1], many).astype(np.int64)
            value = np.repeat(weight[known % code.shape[1]], many) * self.weight[at]
            out[part] = np.bincount(word * self.n + self.mark[at], value, len(part) * self.n).reshape(len(part), self.n) / norm[:, None]
        for _ in range(SQUARED):
            out *= out
        return out


@dataclass
class Model:
    like: Likeness | None
    each: np.ndarray
    offset: float
    fit: np.ndarray
    share: float

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.float32)
        for i in range(0, len(words), 4096):
            out[i : i + 4096] = self.like(words[i : i + 4096]) @ self.each + self.offset
        return out

    def features(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """A row for each text. known: margins of words seen before, added to."""
        found = [set(words_of(t)) for t in texts]
        new = list(set().union(*found) - known.keys())
        parts = [readings(w) for w in new]
        each = list({p for ps in parts for p in ps})
        margin = dict(zip(each, self.margins(each).tolist(), strict=True))
        for w, ps in zip(new, parts, strict=True):
            known[w] = max((margin[p] for p in ps), default=LEAST)
        rows = np.zeros((len(texts), 7), np.float32)
        for row, ws in zip(rows, found, strict=True):
            m = np.sort(np.array([LEAST, LEAST, LEAST, *(known[w] for w in ws)], np.float32))[:-4:-1]
            row[:] = (*(m > CLEAR), *np.clip(m, LEAST, MOST), (m[0] > CLEAR) * np.log1p(len(ws)))
        return rows

    def scores(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        if not self.fit.size:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-(self.features(texts, known) @ self.fit[:-1] + self.fit[-1]).astype(np.float64)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights and offset that minimise the squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        step = np.linalg.solve(a.T @ x[inside] + ridge * len(x) * np.eye(len(w)) * 0.1, a.T @ y[inside])
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (weight * (y - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], labels: list[int], share: float) -> Model:
    """share: the true share of label 1, of which the sample needn't be an image."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(None, np.zeros(0), 0.0, np.zeros(0), float(share))
    number: dict[str, int] = {}
    docs = [np.array(sorted({number.setdefault(p, len(number)) for w in words_of(t) for p in pieces(bare(w)) if p}), np.int32) for t in texts]
    # Copies of a document count once: they mostly share the word with the lowest hash.
    low = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in number])
    groups: dict[tuple[int, int], list[np.ndarray]] = {}
    for d, kind in zip(docs, labels, strict=True):
        groups.setdefault((kind, int(low[d].min()) if d.size else -1), []).append(d)
    counts = np.zeros((2, len(number)), np.int64)
    for (kind, _), ds in groups.items():
        counts[kind][np.unique(np.concatenate(ds))] += 1
    n0, n1 = (sum(k == kind for k, _ in groups) for kind in (0, 1))
    logs = np.log((counts[1] + 0.1) / (n1 + 0.2)) - np.log((counts[0] + 0.1) / (n0 + 0.2))
    df = [dict(zip(number, c.tolist(), strict=True)) for c in counts]
    odds = dict(sorted(zip(number, logs.tolist(), strict=True)))
    # A word is telling if toxic documents are more among its documents than chance gives most words (Chernoff's bound).
    both, part = counts.sum(axis=0), n1 / (n0 + n1)
    mine = np.clip(counts[1] / np.maximum(both, 1), 1e-9, 1 - 1e-9)
    beyond = both * (mine * np.log(mine / part) + (1 - mine) * np.log((1 - mine) / (1 - part)))
    sure = (beyond > SURE * np.log(max(2, (both > 2).sum()))) & (logs > 1.5)
    able = dict.fromkeys(sorted(w for w, ok in zip(number, sure.tolist(), strict=True) if ok)).keys()
    every = [w for w, o in odds.items() if o < 1 and df[0][w]]
    value, bar, hard = {w: min(odds[w], 2.0) + 0.3 * np.log1p(df[1][w]) for w in able}, 0.0, dict.fromkeys(sorted(every, key=lambda w: (-df[0][w], w))[:MINED])
    hard |= dict.fromkeys(every[:: max(1, len(every) // MINED)])
    sentences = (s for t, k in zip(texts, labels, strict=True) if k for s in SENTENCE.split(t))
    told = [s for s in ({p for w in words_of(s) for p in pieces(bare(w)) if p in able} for s in sentences) if s]
    model = Model(None, np.zeros(0), 0.0, np.zeros(0), float(share))
    for _ in range(ROUNDS):
        good: Counter[str] = Counter()
        for s in told:
            top = max(s, key=lambda w: (value[w], w))
            if value[top] > bar:
                good[top] += 1
        if not good:
            break
        plain = [w for w in hard if w not in good]
        landmarks = [w for w, _ in good.most_common(LANDMARKS // 2)]
        landmarks += plain[-LANDMARKS // 4 :] + plain[: LANDMARKS - len(landmarks) - LANDMARKS // 4]
        inserted = [w[: k + 1] + c + w[k + 1 :] for w in good if len(w) > 3 for k, c in ((len(w) // 3, "*"), (len(w) // 2, "x"), (len(w) // 2, w[len(w) // 2]))]
        words = [*good, *inserted, *plain]
        model.like = Likeness(landmarks)
        size, vec = np.linalg.eigh(model.like(landmarks).astype(np.float64))
        whiten = vec / np.sqrt(np.maximum(size, 1e-3)) @ vec.T
        sign = np.concatenate([np.ones(len(good) + len(inserted)), -np.ones(len(plain))])
        even = len(plain) / len(good) / 4
        weight = np.concatenate([np.sqrt([good[w] for w in good]) * even, np.full(len(inserted), even / 2), np.sqrt([df[0][w] for w in plain])])
        w = _machine(model.like(words) @ whiten, sign, weight)
        model.each, model.offset = (whiten @ w[:-1]).astype(np.float32), float(w[-1])
        value, bar = dict(zip(able, model.margins(list(able)).tolist(), strict=True)), 0.0
        margin = dict(zip(every, model.margins(every).tolist(), strict=True))
        hard |= dict.fromkeys(sorted(every, key=lambda w: (-margin[w], w))[:MINED])
    if model.like is None:
        return model
    x = np.concatenate([model.features(texts[i : i + 250], {}) for i in range(0, len(texts), 250)])
    true = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.fit = _logistic(x, y, true)
    return model


_KNOWN: dict[str, dict[str, float]] = {}


def scorer(spark: SparkSession, model: Model):
    """A function of a text column that gives scores; the model is of fixed size and sent to each executor once."""
    sent, key = spark.sparkContext.broadcast(model), unique("toxicity")

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for i in range(0, len(batch), 256):
                known = _KNOWN.setdefault(key, {})
                if len(known) > CACHED:
                    known.clear()
                out.append(sent.value.scores([t.as_py() or "" for t in batch[i : i + 256]], known))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    f = F.arrow_udf(score, DoubleType()).asNondeterministic()
    return lambda text: f(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return fitted_on_sample(docs, labels.filter(~held_out(F.col("doc_id"))), "toxic", SAMPLE, SAMPLE_BYTES, train)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is under a half."""
    score = fresh("score", docs.columns)
    scored = docs.withColumn(score, scorer(docs.sparkSession, fitted(docs, labels))(F.col("text")))
    return scored.filter(F.col(score) < 0.5).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(spark, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

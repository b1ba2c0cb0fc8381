"""Language model: likelihoods token by token, distributed training against the unigram share, edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from readweave.llm import lm

SF = "/root/testdata/sf0.001"


def plain_score(model, text):
    p, v = lm.parameters(model.flat), model.vocabulary
    numbers = lm.tokens(text.encode()).tolist()
    kinds = [lm.CLASSES] * lm.SIDE + [int(v.classes[n]) for n in numbers] + [lm.CLASSES] * lm.SIDE
    total = 0.0
    for i, n in enumerate(numbers):
        at = i + lm.SIDE
        hidden = p["bias"].astype(float).copy()
        for k, d in enumerate([*range(-lm.SIDE, 0), *range(1, lm.SIDE + 1)]):
            hidden += p["near"][k][kinds[at + d]]
        z = np.maximum(hidden, 0) @ p["out"] + p["out_bias"]
        total += z[kinds[at]] - math.log(np.exp(z - z.max()).sum()) - z.max() + v.shares[n]
    return len(numbers), total


def test_scores_and_probabilities(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.fitted(docs.select(lm.raw(docs.text).alias("text")))
    v = model.vocabulary
    assert np.allclose(np.bincount(v.classes, np.exp(v.shares.astype(float)), lm.CLASSES), 1, atol=1e-3)
    got = {r["doc_id"]: r for r in lm.op4_lm(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[:40]:
        n, total = plain_score(model, r["text"])
        assert got[r["doc_id"]]["n_tokens"] == n
        assert abs(got[r["doc_id"]]["log_likelihood"] - total) < 1e-2 * max(1, abs(total))
    counts = np.zeros(lm.BUCKETS)
    for r in rows:
        np.add.at(counts, lm.tokens(r["text"].encode()), 1)
    unigram = (counts * np.log((counts + 1) / (counts + 1).sum())).sum()
    assert sum(r["log_likelihood"] for r in got.values()) > unigram


def test_gradient():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, lm.BUCKETS)
    flat = lm.first_parameters(counts, lm.Vocabulary.of(counts))
    text = [rng.integers(0, lm.CLASSES, 200).astype(np.uint8)]
    joined, at, _ = lm._padded(text)
    at = at[::lm.STEP]

    def loss(f):
        z = lm._forward(lm.parameters(f), lm._around(joined, at))[1]
        return -z[np.arange(len(at)), joined[at]].mean()

    new, squares = flat.copy(), np.zeros_like(flat)
    assert lm.train(new, squares, text, 0) == len(at)
    grad = np.sqrt(squares)
    for k in rng.choice(np.flatnonzero(grad > 1e-3), 8, replace=False):
        up, down = (flat.astype(np.float64) for _ in range(2))
        up[k] += 1e-3
        down[k] -= 1e-3
        assert abs(abs(loss(up) - loss(down)) / 2e-3 - grad[k]) < 0.05 * grad[k] + 1e-4
    assert loss(new) < loss(flat)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, " \t")], [(1, "a b"), (1, "a b"), (None, "c " * 3000)]])
def test_edges(spark, rows):
    out = lm.scored(spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id int, text string, lm int"))
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "lm"]
    for r in got:
        assert r["lm"]["n_tokens"] == len((r["text"] or "").split()) and (r["lm"]["log_likelihood"] < 0) == (r["lm"]["n_tokens"] > 0)


def test_rounds_reach_every_token():
    rng = np.random.default_rng(6)
    classes = [rng.integers(0, lm.CLASSES, n).astype(np.uint8) for n in (1, 2, 3, 4, 9, 1300)]
    counts = rng.integers(0, 50, lm.BUCKETS)
    flat = lm.first_parameters(counts, lm.Vocabulary.of(counts))
    for texts in [classes, *([c] for c in classes)]:
        seen = [lm.train(flat.copy(), np.zeros_like(flat), texts, turn) for turn in range(lm.ROUNDS)]
        assert sum(seen) == sum(map(len, texts))



def test_texts_are_read_and_split_once(spark):
    read = spark.sparkContext.accumulator(0)

    def passed(text):
        read.add(1)
        return text

    texts = spark.createDataFrame([(i, f"a b {i} " * 9) for i in range(40)], "doc_id int, text string")
    docs = texts.withColumn("text", F.udf(passed, "string").asNondeterministic()("text"))
    out = lm.scored(docs, keep=["doc_id"])
    assert out.columns == ["doc_id", "lm"] and all(r["lm"]["n_tokens"] == 27 for r in out.collect())
    # the text is asked for by its numbers and by its size
    assert read.value <= 2 * 40


def test_each_round_trains_on_every_token(spark, monkeypatch):
    texts = spark.createDataFrame([(f"a b c {i} " * (1 + i % 5),) for i in range(30)], "text string").coalesce(1)
    words = sum(4 * (1 + i % 5) for i in range(30))
    learned = []

    real = type(texts).mapInArrow

    def watched(self, func, schema, *more, **named):
        out = real(self, func, schema, *more, **named)
        if "seen" in str(schema):
            learned.append(out.agg(F.max("seen")).first()[0])
        return out

    monkeypatch.setattr(type(texts), "mapInArrow", watched)
    assert lm.fitted(texts.select(lm.raw(texts.text).alias("text"))) is not None
    assert learned == [words] * lm.ROUNDS

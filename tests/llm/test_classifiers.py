"""Toxicity and quality: held-out accuracy, kernel and gradients against plain versions, edge cases."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from readweave.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def scored_labels(spark, query, column, folds, held):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    return [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]


@pytest.mark.parametrize(("query", "column", "folds", "held"), [(toxicity.op6_toxicity, "toxic", 5, 0), (quality.op2_quality, "quality", 3, 1)])
def test_held_out(spark, query, column, folds, held):
    pairs = scored_labels(spark, query, column, folds, held)
    common = max(sum(y == k for y, _ in pairs) for k in (0, 1))
    right = sum(y == p for y, p in pairs)
    assert right > common and right >= 0.88 * len(pairs)


def plain_kernel(a, b):
    def triples(word):
        c = [0, *toxicity._coded([word], len(word))[0][1:-1].tolist(), 0]
        out, bins = {}, {}
        for i, j, k in combinations(range(len(c)), 3):
            if k - i < toxicity.REACH:
                code, w = (c[i] * 64 + c[j]) * 64 + c[k], toxicity.DECAY ** (k - i + 1)
                out[code] = out.get(code, 0) + w
                bins[code * 31 % toxicity.BINS] = bins.get(code * 31 % toxicity.BINS, 0) + w
        return out, sum(v * v for v in bins.values()) ** 0.5

    (x, nx), (y, ny) = triples(a), triples(b)
    return (sum(v * y.get(k, 0) for k, v in x.items()) / nx / ny) ** 2**toxicity.SQUARED


def test_kernel():
    marks, words = ["idiot", "scum", "über"], ["idiot", "i-diot", "idi", "x", "scumm", "hehehehe"]
    got = toxicity.Likeness(marks)(words)
    assert np.allclose(got, [[plain_kernel(w, m) for m in marks] for w in words], atol=1e-5)
    assert got[1, 0] > 10 * got[2, 1]


def test_gaps_are_tolerated():
    words = "the of river stone cloud walk table light green seven".split()
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(400):
        t = [words[k] for k in rng.integers(0, len(words), 30)] + [f"own{i}"]
        if i % 4 == 0:
            t[5] = ["moron", "imbecile", "scoundrel"][i // 4 % 3]
        texts.append(" ".join(t) + ".")
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels, 0.25)
    got = model.scores(["the river imbecile of", "the imbe*cile of", "the imbecxile of", "a m o r o n of the", "of m.o_r.o.n, the", "the river", ""], {})
    assert (got[:5] > 0.5).all() and (got[5:] < 0.5).all()


def test_network_gradient():
    rng = np.random.default_rng(1)
    shape = {"embed": (256, quality.EMBED), "filters": (quality.WIDTH * quality.EMBED, quality.FILTERS), "bias": (quality.FILTERS,), "mix": (3 * quality.FILTERS, quality.HIDDEN), "mix_bias": (quality.HIDDEN,), "out": (quality.HIDDEN,), "out_bias": (1,)}
    w = {k: rng.standard_normal(s) * 0.3 for k, s in shape.items()}
    text = bytes(rng.integers(65, 90, 1500).astype(np.uint8))
    loss = lambda: float(np.log1p(np.exp(quality._combine(w, quality._pooled(w, text))[-1])))
    grad = {k: np.zeros(v.shape) for k, v in w.items()}
    quality._gradient(w, text, 0, grad, 1.0)
    for k, g in grad.items():
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            at = np.unravel_index(i, g.shape)
            old, w[k][at] = w[k][at], w[k][at] + 1e-5
            up = loss()
            w[k][at] = old - 1e-5
            down = loss()
            w[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_parts_of_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    w = {"embed": rng.standard_normal((256, quality.EMBED)), "filters": rng.standard_normal((quality.WIDTH * quality.EMBED, quality.FILTERS)), "bias": np.zeros(quality.FILTERS)}
    for n in (0, 1, 255, 256, 257, 4096, 5000, 12_345):
        text = bytes(rng.integers(0, 256, n).astype(np.uint8))
        whole = quality._pooled(w, text).max(axis=0)
        monkeypatch.setattr(quality, "AT_ONCE", 1024)
        assert np.allclose(quality._pooled(w, text).max(axis=0), whole)
        monkeypatch.undo()


@pytest.mark.parametrize("module", [toxicity, quality])
@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 1), (1, None), (2, 0), (3, 1), (3, 1)]])
def test_edges(spark, module, labels):
    column = "toxic" if module is toxicity else "quality"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b!", 1), (3, "a b!", 1), (None, "x " * 60_000, 2)], "doc_id int, text string, score int")
    given = spark.createDataFrame(labels, f"doc_id int, {column} int")
    kept = (toxicity.accepted if module is toxicity else quality.good_documents)(docs, given)
    assert kept.columns == docs.columns and kept.count() <= 5
    assert kept.limit(0).count() == 0 and (toxicity.accepted(docs.limit(0), given) if module is toxicity else quality.good_documents(docs.limit(0), given)).count() == 0

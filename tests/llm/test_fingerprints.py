"""Weighted sampling against exact similarity; edited documents against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from readweave.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def plain(rows):
    """rows: (doc_id, text)."""
    rows = [(d, t or "") for d, t in rows]
    order = sorted(r for r in rows if r[0] is not None)
    out = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        q = len(t) // 4
        new = t[: len(t) - q] + after[:q]
        a, b, c = (fp.of_text(x.encode()) for x in (t, new, after))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float(np.mean(a == b)), float(np.mean(a == c))))
    for d, t in rows:
        if d is None:
            new = t[: len(t) - len(t) // 4]
            a, b = (fp.of_text(x.encode()) for x in (t, new))
            out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float(np.mean(a == b)), 0.0))
    return sorted(out, key=str)


def test_query(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 16)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = fp.op9_fingerprints(spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs)


@pytest.mark.parametrize("rows", [
    [], [(None, "a b c d e f")], [(5, None)], [(1, "x"), (1, "x"), (1, "y z"), (9, ""), (None, None), (-7, "ä ö ü ß é è"), (1 << 62, "a " * 5000)],
])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(d, t, 0, "z") for d, t in rows], "doc_id bigint, text string, part int, guest string")
    assert sorted((tuple(r) for r in fp.edited_documents(docs).collect()), key=str) == plain(rows)


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(0)
    hits = expected = 0.0
    for i in range(120):
        words = [f"w{i}_{j}" for j in range(30)]
        a, b = (Counter({w: int(n) for w, n in zip(words, rng.geometric(0.3, 30) * (rng.random(30) < 0.7), strict=True) if n}) for _ in range(2))
        sig = []
        for c in (a, b):
            h = {fp.xxhash.xxh64_intdigest(w, fp.SEED): n for w, n in c.items()}
            keys = sorted(h)
            sig.append(fp.signature(np.array(keys, np.uint64), np.array([h[k] for k in keys])))
        hits += float(np.mean(sig[0] == sig[1]))
        expected += sum((a & b).values()) / sum((a | b).values())
    assert abs(hits - expected) / 120 < 0.015


def test_equal_texts_and_column(spark):
    got = [r[0] for r in spark.createDataFrame([("a b c",), ("a b c",), ("a b d",), (None,)], "t string").select(fp.fingerprint(fp.F.col("t").cast("binary"))).collect()]
    assert got[0] == got[1] != got[2] and got[3] == "0" * 4 * fp.SAMPLES

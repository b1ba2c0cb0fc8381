"""SimHash: fingerprints by definition, codes, groups against all pairs."""

import numpy as np
import pytest
import xxhash
from readweave.llm import simhash
from readweave.llm.components import roots
from readweave.session import cut_lineage

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """rows: (doc_id, fp); the smallest id reachable for each row."""
    fps = sorted({fp for _, fp in rows})
    label = {fp: fp for fp in fps}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    low = {}
    for d, fp in rows:
        if d is not None:
            low[top(fp)] = min(d, low.get(top(fp), d))
    return sorted(((d, f"{fp:016x}", low.get(top(fp))) for d, fp in rows), key=str)


def test_codes():
    code = np.unique(simhash.nearest_golay(np.arange(1 << 23)))
    assert code.size == 1 << 12 and min(int(c).bit_count() for c in code if c) == 7
    ham = np.unique(simhash._hamming())
    assert ham.size == 1 << 11 and min(int(c).bit_count() for c in ham if c) == 3
    assert all((int(w) ^ int(simhash._hamming()[w])).bit_count() <= 1 for w in range(1 << 15))


def test_anchors_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        y = x
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y ^= 1 << int(b)
        a = simhash.anchors(np.array([x, y], np.uint64))
        assert set(a[0].tolist()) & set(a[1].tolist())


def test_stars_many():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)]))
    member, first = simhash.stars(prints)
    got = plain_components([(i, int(p)) for i, p in enumerate(prints)])
    assert len(member) == len(prints) - len({c for _, _, c in got})


def test_query_matches_all_pairs(spark):
    rows = [tuple(r) for r in simhash.op1_simhash(spark, SF).collect()]
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(rows, key=str) == plain_components(docs)


def test_dense_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    prints = {0, 1 << 63}
    for _ in range(150):
        x = 0x1234567890ABCDEF
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    rows = list(enumerate(sorted(prints)))
    signed = [(i, i + 100, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows]
    out = simhash.near_duplicates(spark.createDataFrame(signed, "row bigint, doc_id bigint, fp bigint"))
    got = sorted(((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in out.collect()), key=str)
    assert got == plain_components([(i + 100, fp) for i, fp in rows])
    assert out.filter("stays").count() == len({c for _, _, c in got})


def test_chain_of_links(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b c d e"), (2, "A B C D E"), (2, "A B C D E"), (3, ""), (4, None), (5, " \t")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, fp string, row int")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == ([2, 3] if rows else [])


def test_copies_are_not_broadcast(spark):
    # fingerprints are few bytes, their copies at anchors some fifty times as many
    rng = np.random.default_rng(5)
    prints = [(int(x),) for x in rng.integers(0, 1 << 62, 500)]
    found = simhash.links(cut_lineage(spark.createDataFrame(prints, "fp bigint")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

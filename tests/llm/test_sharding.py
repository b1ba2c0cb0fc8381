"""Ring walk against one key at a time; balance, movement and edge cases."""

import random

import pytest
from readweave.llm import sharding as s


def plain_walk(counts, shards):
    """Round by round, key by key: each key asks the node it has come to, in ring order."""
    nodes, total = s.ring(shards), sum(counts.values())
    room = [total // shards + (k < total % shards) for k in range(shards)]
    keys = [(place, rank, next((i for i, (p, _) in enumerate(nodes) if p >= place), 0)) for place in sorted(counts) for rank in range(counts[place])]
    got, slots = {}, [0] * shards
    while keys:
        over = []
        for place, rank, at in keys:
            k = nodes[at][1]
            if room[k]:
                room[k] -= 1
                got[place, rank] = (k, slots[k])
                slots[k] += 1
            else:
                over.append((place, rank, at))
        keys = []
        for place, rank, at in over:
            while not room[nodes[at][1]]:
                at = (at + 1) % len(nodes)
            keys.append((place, rank, at))
    return got


def test_walk():
    rng = random.Random(1)
    for n in (1, 7, 400):
        counts = {}
        for _ in range(n):
            place = int(rng.random() ** 3 * s.CELLS)
            counts[place] = counts.get(place, 0) + rng.randrange(1, 9)
        got = {(p, r): (k, first + r - lo) for p, lo, hi, k, first in s.placed(counts, 8) for r in range(lo, hi)}
        assert got == plain_walk(counts, 8)


def test_growing_moves_little():
    assert [p for p in s.ring(9) if p[1] < 8] == s.ring(8)
    rng = random.Random(2)
    keys = [rng.randrange(s.CELLS) for _ in range(20_000)]
    counts = {}
    for k in keys:
        counts[k] = counts.get(k, 0) + 1
    where = [{(p, r): k for p, lo, hi, k, _ in s.placed(counts, n) for r in range(lo, hi)} for n in (8, 9)]
    moved = sum(where[0][x] != where[1][x] for x in where[0]) / len(keys)
    assert 1 / 9 <= moved < 0.35


@pytest.mark.parametrize("rows", [[], [(None, None)], [(i // 3, f"text {i % 50}") for i in range(1000)] + [(5, "same")] * 200 + [(None, None)] * 33 + [(1, "x" * 100_000)]])
def test_shards(spark, rows):
    docs = spark.createDataFrame([(d, t, 99, "c") for d, t in rows], "doc_id int, text string, shard int, lo string")
    out = s.shard_documents(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lo", "shard", "slot"])
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = {(r["doc_id"], r["text"], r["shard"]) for r in s.shard_documents(docs.repartition(7)).collect()}
    assert rows[200:] or again == {(r["doc_id"], r["text"], r["shard"]) for r in got}

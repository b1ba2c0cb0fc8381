"""Targets and schedule against plain Python; edge cases. The query's SQL is compared in test_queries."""

import re

import pytest
from readweave.llm import mixing as m
from readweave.llm.common import row_key
from readweave.session import cut_lineage


def plain_targets(sizes):
    """sizes: source to words. Shares out again until no target is above its limit."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), m.SHARE * sum(sizes.values())
    while left > 1e-6:
        free = [s for s in order if target[s] < m.CAP * sizes[s] - 1e-9]
        unit = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += unit * weight[s]
        left = sum(max(0.0, t - m.CAP * sizes[s]) for s, t in target.items())
        target = {s: min(t, m.CAP * sizes[s]) for s, t in target.items()}
    return target


CASES = [
    [],
    [(1, None, None)],
    [(1, "a", ""), (2, None, "x")],
    [(i, ["b", "a", None, "é", "Z"][i % 5], "w " * (i * 37 % 400)) for i in range(200)] + [(7, "hot", "q \t\n q" * 90)] * 60 + [(None, "hot", "w " * 30_000)],
]


@pytest.mark.parametrize("rows", CASES)
def test_mix(spark, rows):
    docs = spark.createDataFrame([(d, s, t, 1.0, "k") for d, s, t in rows], "doc_id int, source string, text string, target double, row string")
    sized = cut_lineage(row_key(docs.select("doc_id", "source", m.size("text").alias("size")), "row"))
    sources = cut_lineage(m.targets(sized))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    got = {r["source"]: r["target"] or 0.0 for r in sources.collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    schedule = m.schedule(sized, sources).collect()
    by_slot, by_row, by_source = {}, {}, {}
    for r in schedule:
        by_slot[r["slot"]] = by_slot.get(r["slot"], 0) + r["n_words"]
        by_row[r["row"]] = by_row.get(r["row"], 0) + r["n_words"]
    for r in sized.collect():
        assert by_row.get(r["row"], 0) <= m.CAP * r["size"]
        by_source[r["source"]] = by_source.get(r["source"], 0) + by_row.get(r["row"], 0)
    assert all(n <= m.BLOCK for n in by_slot.values())
    assert all(abs(by_source[s] - want[s]) <= 6 * m.BLOCK for s in want)
    mixed = m.mix_documents(docs)
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r["source"]] = copies.get(r["source"], 0) + size(r["text"])
    longest = max((size(t) for _, _, t in rows), default=0)
    assert all(abs(copies.get(s, 0) - by_source[s]) <= longest for s in want)


def test_stretches_are_near_the_weights(spark):
    sources = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.5, 0.8), (2, 0.8, 1.0)], "idx int, lo double, hi double")
    rows = sorted((r["slot"], r["idx"], r["rank"]) for r in m.slots(spark, sources, 3000).collect())
    seen = [0, 0, 0]
    for n, (slot, idx, rank) in enumerate(rows):
        assert (slot, rank) == (n, seen[idx])
        seen[idx] += 1
        assert all(abs(seen[i] - (n + 1) * p) < 4 for i, p in enumerate((0.5, 0.3, 0.2)))

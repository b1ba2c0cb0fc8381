"""Removal of repeated passages against a plain version; the automaton against substring search; the query's SQL is in test_queries."""

import random

import pytest
from readweave.llm import substrings as sub


def plain(rows, window):
    """(n_words, spans removed, kept words) of each (id, text)."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (n, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1 if n is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(n, first.get(key, n))
    for (n, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1 if n is not None else 0) if first[tuple(w[i : i + window])] < n for j in range(i, i + window)}
        starts = [j for j in sorted(gone) if j - 1 not in gone]
        spans = [(j, next(e for e in range(j, len(w) + 1) if e not in gone)) for j in starts]
        yield len(w), len(gone), spans, b" ".join(x for j, x in enumerate(w) if j not in gone).decode()


def random_rows(rng, n):
    passages = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(5, 40))] for _ in range(5)]
    rows = []
    for i in range(n):
        words = []
        while rng.random() < 0.7:
            p = rng.choice(passages)
            words += p[rng.randrange(len(p)) :][: rng.randrange(1, 40)] if rng.random() < 0.8 else [f"w{rng.randrange(30)}é"]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


def test_automaton():
    rng = random.Random(0)
    for _ in range(60):
        runs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 25))] for _ in range(12)]
        automaton, window = sub.SuffixAutomaton(), rng.randrange(1, 6)
        for n, words in enumerate(runs):
            want = []
            for i in range(len(words) - window + 1):
                key = words[i : i + window]
                want.append(next((m for m, r in enumerate(runs[:n]) if any(r[j : j + window] == key for j in range(len(r)))), None))
            assert automaton.first_of(words, window) == want
            automaton.add(words, n)


@pytest.mark.parametrize("settings", [{}, {"GROUP_BYTES": 500, "SHARD_BYTES": 300, "BUCKET_BYTES": 400}, {"COMMON": 0, "GROUP_BYTES": 700, "SHARD_BYTES": 900}])
def test_rows(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(sub, k, v)
    rng = random.Random(3)
    rows = random_rows(rng, 120)
    long = " ".join(f"v{rng.randrange(9000)}" for _ in range(30_000))
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[1][1] + " x"), (None, long), (503, long), (-1, long[:5000]), (503, long), rows[5], (504, "z " * 2000), (505, "z " * 50)]
    frame = spark.createDataFrame([(n, t, i, "k") for i, (n, t) in enumerate(rows)], "doc_id int, text string, at int, words string").repartition(4)
    got = sub.repeats(frame, "f")
    assert got.columns == [*frame.columns, "f"]
    found = {r["at"]: (r["f"]["n_words"], r["f"]["n_removed"], [tuple(s) for s in r["f"]["spans"]], r["f"]["kept"]) for r in got.collect()}
    assert found == dict(enumerate(plain(rows, 13)))


def test_other_window(spark):
    rows = random_rows(random.Random(4), 60)
    got = sub.repeats(
        spark.createDataFrame(rows, "id long, body string"), "f", "id", "body", 5, 3
    )
    assert {r["id"]: (r["f"]["n_words"], r["f"]["n_removed"]) for r in got.collect()} == {i: w[:2] for i, w in enumerate(plain(rows, 5))}


def test_empty(spark):
    frame = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert sub.repeats(frame.limit(0), "f").collect() == []
    assert sub.repeats(frame, "f").first()["f"]["kept"] == ""

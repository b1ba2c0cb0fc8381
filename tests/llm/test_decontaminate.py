"""Wu-Manber search against a plain search; edge cases; the query's SQL is compared in test_queries."""

import random
import re

import pytest
from readweave.llm import decontaminate as d


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - 9)) if w else ():
            window = w[i : i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def random_case(rng):
    vocabulary = ["a", "be", "the", "émile", "x1", "longerword", "ß"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(8)]
    docs = []
    for _ in range(30):
        parts = [rng.choice(vocabulary + ["zz", "y"]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.6:
            w = plain_words(rng.choice(items)[1])
            parts[len(parts) // 2 : len(parts) // 2] = w[rng.randrange(3) :]
        docs.append(rng.choice([" ", "--", "\n"]).join(parts).upper() if rng.random() < 0.3 else " ".join(parts))
    return docs, items


def test_search_in_one_pattern_set():
    rng = random.Random(0)
    for _ in range(40):
        docs, items = random_case(rng)
        block = {}
        for i, t in items:
            for p in d.item_patterns(t.encode(), 10):
                block.setdefault(p, []).append(str(i))
        for t in docs:
            f = d._found(d.WuManber(list(block)), block, t.encode(), None)
            assert (f["n_words"], sum(s["end"] - s["start"] for s in f["spans"]), f["items"]) == plain(t, items)


@pytest.mark.parametrize("size", [1, 8_000_000])
def test_frames(spark, monkeypatch, size):
    monkeypatch.setattr(d, "BLOCK_BYTES", size)
    docs, items = random_case(random.Random(1))
    docs += [None, "", "--", docs[0], "word " * 30_000 + items[5][1]]
    items += [(None, "zz y zz"), (3, items[3][1]), (9, None)]
    frame = spark.createDataFrame([(i, t, 0, "q") for i, t in enumerate(docs)], "doc_id int, text string, n_words int, items string")
    got = d.occurrences(frame, spark.createDataFrame(items, "item_id int, text string"), "found")
    assert got.columns == [*frame.columns, "found"]
    for r in got.collect():
        f = r["found"]
        assert (f["n_words"], sum(s["end"] - s["start"] for s in f["spans"]), f["items"]) == plain(docs[r["doc_id"]], items)
    clean = d.clean_documents(frame, spark.createDataFrame(items, "item_id int, text string"))
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate(docs) if not plain(t, items)[2]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    items = spark.createDataFrame([], "item_id int, text string")
    assert d.occurrences(docs, items, "f").first()["f"]["items"] == []
    assert d.occurrences(docs.limit(0), docs.selectExpr("doc_id AS item_id", "text"), "f").collect() == []

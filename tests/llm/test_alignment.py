"""Diagonal run skipping against common ends by sets; counts of links against a plain version; edge cases."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pytest
import sentencepiece
from readweave.llm import alignment as al
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n", "a\n\n  b  c \t d", " x", "x ", "a▁b c", "a\x1c b", "<|endoftext|> <s> </s> <unk> x", "é b  日本語 🎉x y", "ﬁ ½",
    "  a 　 b", "a ́b", "don't we'll  they 're", "same words", "same words", "q" * 300 + " " + "q" * 300,
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(al.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=al.B_FILE)


def plain_groups(tools, text):
    """[(ids of A, ids of B)] of the groups, from the libraries' own encoders and sets of ends."""
    if not text:
        return []
    alphabet = al.byte_alphabet()
    a = tools[0].encode(" " + text, add_special_tokens=False)
    b = tools[1].encode(text)
    token_a = [bytes(alphabet[c] for c in t) for t in a.tokens]
    token_b = [bytes([int(p[3:5], 16)]) if tools[1].is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, tools[1].id_to_piece(b), strict=True)]
    if not b"".join(token_a) == b"".join(token_b) == (" " + text).encode():
        return []
    ends = []
    for ids, tokens in ((a.ids, token_a), (b, token_b)):
        at, here = 0, []
        for i, t in zip(ids, tokens, strict=True):
            at += len(t)
            here.append((at, i))
        ends.append(here)
    common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    out = [([], []) for _ in common]
    for k, side in enumerate(ends):
        for e, i in side:
            out[bisect_left(common, e)][k].append(i)
    return out


def plain_rows(tools, texts):
    groups = [plain_groups(tools, t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for link in links for p in link)
    most = Counter()
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    for g, link in zip(groups, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(link.values()), sum(n for p, n in link.items() if docs[p] == most[p[0]]),
            sum(n * docs[p] for p, n in link.items()), hashlib.sha256(written.encode()).hexdigest() if g else "",
        )


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_common_ends():
    rng = random.Random(0)
    for _ in range(500):
        total = rng.randrange(1, 120)
        ea, eb = (sorted({*rng.sample(range(1, total + 1), rng.randrange(total)), total}) for _ in range(2))
        both = [e for e in ea if e in set(eb)]
        a, b = al.common_ends(ea, eb)
        assert [ea[i - 1] for i in a] == [eb[j - 1] for j in b] == both
    long = list(range(1, 5001))
    assert all(list(x) == long for x in al.common_ends(long, long))


@pytest.mark.parametrize("segment, batch", [(1_000_000, 8_000_000), (20, 300)])
def test_counts(spark, tools, monkeypatch, segment, batch):
    monkeypatch.setattr(al, "SEGMENT", segment)
    monkeypatch.setattr(al, "BATCH_CHARS", batch)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id int, text string, batch int, n string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in al.link_counts(docs).collect()}
    assert got == dict(enumerate(plain_rows(tools, texts)))


def test_groups(spark, tools):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)], "a int, text string, ends_a int")
    got = al.align(docs, "got")
    assert got.columns == ["a", "text", "ends_a", "got"]
    for r in got.collect():
        g, want = r["got"], plain_groups(tools, ODD[r["a"]])
        assert [tuple(x) for x in zip(g["ends_a"], g["ends_b"], strict=True)] == [
            (sum(len(a) for a, _ in want[: k + 1]), sum(len(b) for _, b in want[: k + 1])) for k in range(len(want))
        ]
        assert (g["a"], g["b"]) == ([i for a, _ in want for i in a], [i for _, b in want for i in b])


def test_long_and_empty(spark, tools):
    text = "some words\n and more of them  here " * 40_000
    docs = spark.createDataFrame([(None, text), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in al.link_counts(docs).collect()}
    assert got[2] == (0, 0, 0, 0, 0, 0, "")
    assert got[None][0] == len(tools[0].encode(" " + text, add_special_tokens=False).ids) and got[None][4] > 0
    assert al.link_counts(docs.limit(0)).collect() == []
    nothing = al.link_counts(docs.filter("text IS NULL")).collect()
    assert [r["n_links"] for r in nothing] == [0]


def test_query(spark, tools):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in al.op13_alignment(spark, SF).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], plain_rows(tools, [r["text"] for r in rows]), strict=True))

"""Repair against a plain search over whole repairs; chunks of any length; edge cases; the query with its damage."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from readweave.llm import conversations as cv

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain(rows):
    """The result row of one conversation, given its (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    kinds, seen = [], set()
    for _, role, text in rows:
        last = text.strip(WHITE)[-1:]
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserted):
        """(cost, audit, lines put out) from row i on."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for to in moves[state]:
                if to in names:
                    c, a, lines = best(i, to, inserted + 1)
                    found.append((c + 3, "I" + a, (names[to] + ":",) + lines))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, lines = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, lines))
            if kinds[i] not in ("blank", "duplicate"):
                for to in moves[state]:
                    c, a, lines = best(i + 1, to, 0)
                    c += 3 * (kinds[i] == "truncated")
                    if role[:1] == to:
                        found.append((c, "K" + a, (f"{role}:{text}",) + lines))
                    if to in names:
                        found.append((c + 3, "R" + a, (f"{names[to]}:{text}",) + lines))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_chunks_from_all_vectors():
    rng = random.Random(0)
    for _ in range(100):
        codes = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 40)))
        starts = [cv.END, (0, 1, 0, 2), (3, 3, 0, 1), (2, 2, 1, 0)]
        for start, got in zip(starts, cv.run_chunk(codes, starts), strict=True):
            vector, total = start, 0
            for code in reversed(codes):
                vector, least = cv.before(code, vector)
                total += least
            assert got == (vector, total)
        for entry, (audit, state) in enumerate(cv.trace_chunk(codes, cv.END)):
            here, written, after = entry, "", [cv.END]
            for code in reversed(codes[1:]):
                after.append(cv.before(code, after[-1])[0])
            for code, vector in zip(codes, reversed(after), strict=True):
                piece, here = cv.edits(code, vector, here)
                written += piece
            assert (audit, state) == (written, here)


def random_rows(rng, n):
    roles = rng.choice([["user"], ["user", "assistant"], ["system", "user", "assistant"], ["system", "user", "assistant", "tool", "", None, "usr", "Assistant"]])
    texts = ["Yes.", "no", "What? ", " \n", "", None, "ok!\t", "é", "same.", "x. y"]
    turns = [None, *range(-2, n + 3)]
    return [(rng.choice(turns) if rng.random() < 0.3 else i, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{i}.") for i in range(n)]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(cv, "CHUNK", chunk)
    rng = random.Random(chunk)
    talks = {i: random_rows(rng, rng.randrange(1, 14)) for i in range(120)}
    talks[None] = random_rows(rng, 30)
    talks[1000] = [(i, "user", f"{i}.") for i in range(41)]
    talks[1001] = [(7, "assistant", "same.")] * 9
    talks[1002] = [(0, "system", "Be kind. " * 20_000), (None, None, None)]
    talks[1003] = [(i, "user" if i % 3 else "assistant", "Go") for i in range(50)]
    rows = [(c, t, r, x, 0, "q") for c, talk in talks.items() for t, r, x in talk]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, part int, fault string").repartition(3)
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in cv.repair(frame).collect()}
    for c, talk in talks.items():
        assert got[c] == plain(talk), (c, talk)
    assert len(got) == len(talks)


def test_white_space_only(spark):
    """Vertical tabs and form feeds are white space; the letters and digits of their escapes aren't."""
    texts = ["x", "0b", "cxc0", "Go.b", "Go.\x0bx0c", "Go.\x0b", "Go!\x0c \n", "\x0b\x0c", "Go.\xa0", "\\", "Go.\x1f", "Go\x00"]
    talk = [(i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(texts)]
    got = cv.repair(spark.createDataFrame([(1, *row) for row in talk], "conv_id int, turn int, role string, text string")).collect()
    assert [tuple(r[f] for f in FIELDS) for r in got] == [plain(talk)]


def test_empty(spark):
    assert cv.repair(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).collect() == []


def plain_damage(rows):
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 1:
            x = ""
        if kind == 2:
            x = x.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            r = "user"
        yield from [(c, t, r, x)] * {0: 0, 3: 2}.get(kind, 1)


def test_query(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(10**6 + i, None if i % 3 else i, None if i % 4 else "user", None if i % 5 else "Hm.") for i in range(60)] + [(None, i, "user", "a.") for i in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    talks = {c: [] for c, *_ in rows}
    for c, t, r, x in plain_damage(rows):
        talks[c].append((t, r, x))
    got = cv.op11_conversations(spark, str(tmp_path)).collect()
    assert len(got) == len(talks)
    for r in got:
        assert tuple(r[f] for f in FIELDS) == plain(talks[r["conv_id"]])

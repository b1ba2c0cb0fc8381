"""Faults of conversations and their cheapest repair, by a rank-convergence parallel Viterbi.

A conversation is the rows of one id in the order of turn (nulls first), role and text. Each row's first fault counts: blank
(nothing but ASCII white space), duplicate (role and text seen earlier in it), truncated (the last other character is none
of ``.!?``). Roles must read ``(s?(ua)+)?`` by their initials. Edits are Keep (0), Rerole to user or assistant (3), Delete
(4; blanks and duplicates must go) and Insert an empty user or assistant row (3); a truncated row that stays adds 3.

The state before a row is what was put out last: nothing, s, u or a. Costs to the end form a vector of four numbers, taken
row by row from the end. Rows are cut into chunks of ``CHUNK``; each starts from a speculative vector, the one that holds at the end
of a conversation. Fix-up passes rerun chunks from the vectors that others ended with, each only until it differs from the
speculative run by a constant; the rest of the chunk then differs by that constant. They stop once no new vector turns up:
vectors without their least number are few (the edits bound their differences), so passes are few too, whatever the
length. A walk over the chunks then tells which vector each really starts from. From it the chunk traces, for each state it may
be entered in, the cheapest edits; among these the least initial is taken at each step. That gives the ASCII-least audit,
as the costs to the end tell which initials can be part of a cheapest repair.

A conversation's rows are spread over tasks by ranges of turns; what is done in one task for it is a walk over its chunks
and the hash of its repaired text, which can only be taken in order; both stream.

Null roles and texts are one space. Rows with a null id are one conversation. Repeated rows are duplicates. Very long texts are
hashed, not compared. Further columns are ignored. A conversation without rows, and so an empty table, gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readweave.llm.common import table
from readweave.session import cut_lineage, discard

CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_WHITE = " \t\n\x0b\x0c\r"
_INITIALS = "sua"
#: Code of a row: place of its initial (3: another one), 4 more if truncated; GONE: must be deleted.
GONE = 8

#: State reached from each state (nothing, s, u, a) by putting out u or a.
_NEXT = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
Vector = tuple[int, int, int, int]


def _with_inserts(z: int, s: int, u: int, a: int) -> Vector:
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(z, INSERT + u), min(s, INSERT + u), u, a


END: Vector = _with_inserts(0, 99, 99, 0)


def _options(code: int, after: Vector, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost to the end, state reached) of each edit of a row."""
    yield "D", DELETE + after[state], state
    if code == GONE:
        return
    stays = TRUNCATED * (code >= 4)
    initial = code % 4
    if initial == 0 and state == 0:
        yield "K", KEEP + stays + after[1], 1
    to = _NEXT[state]
    yield ("K", KEEP + stays + after[to], to) if initial == to - 1 else ("R", REROLE + stays + after[to], to)


@cache
def before(code: int, after: Vector) -> tuple[Vector, int]:
    """Costs to the end in front of a row, given those behind it; less their minimum, and that minimum."""
    costs = _with_inserts(*(min(c for _, c, _ in _options(code, after, state)) for state in range(4)))
    least = min(costs)
    return tuple(c - least for c in costs), least


@cache
def edits(code: int, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least initials of cheapest edits in front of and at a row, and the state behind it."""
    costs = _with_inserts(*(min(c for _, c, _ in _options(code, after, s)) for s in range(4)))
    cheapest = {e: to for e, c, to in _options(code, after, state) if c == costs[state]}
    if "D" in cheapest:
        return "D", state
    if INSERT + costs[_NEXT[state]] == costs[state]:
        rest, to = edits(code, after, _NEXT[state])
        return "I" + rest, to
    return next((e, cheapest[e]) for e in "KR" if e in cheapest)


_CLOSING = ("", "II", "I", "")


def run_chunk(codes: bytes, starts: list[Vector]) -> list[tuple[Vector, int]]:
    """For each vector behind the chunk the one in front of it, and the costs between. The first is followed through; the
    others only until they differ from it by a constant."""
    path, cost = [starts[0]], [0]
    for code in reversed(codes):
        vector, least = before(code, path[-1])
        path.append(vector)
        cost.append(cost[-1] + least)
    out = [(path[-1], cost[-1])]
    for start in starts[1:]:
        vector, total = start, 0
        for n, code in enumerate(reversed(codes)):
            if vector == path[n]:
                vector, total = path[-1], total + cost[-1] - cost[n]
                break
            vector, least = before(code, vector)
            total += least
        out.append((vector, total))
    return out


def trace_chunk(codes: bytes, start: Vector) -> list[tuple[str, int]]:
    """For each state in front of the chunk the audit of its cheapest repair and the state behind it."""
    after = [start]
    for code in reversed(codes[1:]):
        after.append(before(code, after[-1])[0])
    after.reverse()
    out: list[tuple[str, int]] = []
    seen: dict[tuple[int, int], tuple[int, int]] = {}  # (row, state): entry that passed there, length of its audit
    for entry in range(4):
        state, audit, met = entry, "", False
        for n, code in enumerate(codes):
            if (n, state) in seen:
                other, length = seen[n, state]
                out.append((audit + out[other][0][length:], out[other][1]))
                met = True
                break
            seen[n, state] = (entry, len(audit))
            piece, state = edits(code, after[n], state)
            audit += piece
        if not met:
            out.append((audit, state))
    return out


def _packed(v: Vector) -> int:
    return v[0] << 24 | v[1] << 16 | v[2] << 8 | v[3]


def _unpacked(n: int) -> Vector:
    return n >> 24, n >> 16 & 255, n >> 8 & 255, n & 255


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with ``fault``: blank, duplicate, truncated or null; part, at: their order. Written."""
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    keyed = rows.withColumn("digest", digest)
    again = keyed.groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(F.struct("turn")).alias("earliest"), F.count(F.lit(1)).alias("n"))
    marked = keyed.join(again.filter("n > 1"), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    later = F.coalesce(F.struct("turn") > F.col("earliest"), F.lit(False))
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    kind = F.when(last == "", "blank").when(later, "duplicate")
    ready = marked.select("conv", "turn", "role", "text", kind.alias("kind"), F.coalesce(~last.isin(".", "!", "?"), F.lit(False)).alias("cut"))
    order = ["conv", "turn", "role"]
    laid = ready.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text", F.col("kind").asc_nulls_first())
    numbered = laid.withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, inside, previous = 0, -1, 0, None
        for batch in batches:
            found, chunks = [], []
            for conv, turn, role, text, kind, cut in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "kind", "cut")), strict=True):
                if previous is None or conv != previous[0] or inside == CHUNK:
                    chunk, inside = chunk + 1, 0
                same, previous = previous == (conv, turn, role, text), (conv, turn, role, text)
                found.append(kind or ("duplicate" if same else "truncated" if cut else None))
                chunks.append(chunk)
                inside += 1
            places = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv", "turn", "role", "text", "part")), pa.array(chunks, pa.int64()), places, pa.array(found, pa.string())], _ROW)

    conv_type, turn_type = (dict(rows.dtypes)[c] for c in ("conv", "turn"))
    return cut_lineage(numbered.mapInArrow(number, f"conv {conv_type}, turn {turn_type}, role string, text string, part int, chunk bigint, at bigint, fault string"))


_ROW = ["conv", "turn", "role", "text", "part", "chunk", "at", "fault"]
_CHUNK_ORDER = ("part", "chunk")


def _code() -> Column:
    initial = F.expr(f"instr('{_INITIALS}', substring(role, 1, 1)) - 1")
    live = F.when((initial < 0) | (F.col("role") == ""), 3).otherwise(initial) + F.when(F.col("fault") == "truncated", 4).otherwise(0)
    return F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(live)


def chunk_audits(rows: DataFrame) -> DataFrame:
    """For each chunk of the rows that :func:`faults` numbered: audits and states behind it, by the state it is entered in."""
    conv = f"conv {dict(rows.dtypes)['conv']}"
    place = f"{conv}, part int, chunk bigint"
    listed = rows.groupBy("conv", *_CHUNK_ORDER).agg(F.array_sort(F.collect_list(F.struct("at", _code().cast("int").alias("code")))).alias("rows"))
    by_conv = Window.partitionBy("conv").orderBy(*_CHUNK_ORDER)
    chunks = listed.select(
        "conv", *_CHUNK_ORDER, F.expr("transform(rows, r -> r.code)").alias("codes"),
        F.lag("part").over(by_conv).isNotNull().alias("asked"), F.lead("part").over(by_conv).isNotNull().alias("speculative"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("runs"),
    )
    state = f"{place}, codes array<int>, asked boolean, speculative boolean, runs array<struct<start:int,end:int>>"
    names = ["conv", "part", "chunk", "codes", "asked", "speculative", "runs"]
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def runner(new: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for codes, speculative, runs in zip(*(batch[c].to_pylist() for c in ("codes", "speculative", "runs")), strict=True):
                    starts = [v for v in new if speculative or v == _packed(END)]
                    through = [END, *map(_unpacked, starts)]
                    found = run_chunk(bytes(codes), through)[1:] if starts else []
                    out.append(runs + [{"start": s, "end": _packed(v)} for s, (v, _) in zip(starts, found, strict=True)])
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:-1]), pa.array(out, run_type)], names)

        return run

    known: set[int] = set()
    new = {_packed(END)}
    while new:  # at most as many passes as there are vectors
        done, chunks = chunks, cut_lineage(chunks.mapInArrow(runner(sorted(new)), state))
        discard(done)
        known |= new
        ends = chunks.filter("asked").select(F.explode("runs.end").alias("end")).distinct().collect()  # vectors, a few
        new = {r["end"] for r in ends} - known

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _packed(END)
        for batch in batches:
            starts = []
            for speculative, runs in zip(*(batch[c].to_pylist() for c in ("speculative", "runs")), strict=True):
                if not speculative:
                    start = _packed(END)
                starts.append(start)
                start = {r["start"]: r["end"] for r in runs}[start]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:4]), pa.array(starts, pa.int32())], [*names[:4], "start"])

    from_end = chunks.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("chunk"))
    settled = from_end.mapInArrow(settle, f"{place}, codes array<int>, start int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trace_chunk(bytes(codes), _unpacked(start)) for codes, start in zip(batch["codes"].to_pylist(), batch["start"].to_pylist(), strict=True)]
            audits, exits = pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string())), pa.array([[s for _, s in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:3]), audits, exits], [*names[:3], "audits", "exits"])

    return settled.repartition(*_CHUNK_ORDER).mapInArrow(trace, f"{place}, audits array<string>, exits array<int>")


class _Repaired:
    """One conversation as its rows come by."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = self.state = 0
        self.audit: list[str] = []
        self.pending = ""
        self.hash, self.empty = hashlib.sha256(), True
        self.initial = self.least = self.most = None

    def chunk(self, audits: list[str], exits: list[int]) -> None:
        self.pending = audits[self.state]
        self.audit.append(self.pending)

    def _put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _inserts(self) -> None:
        """Put out the rows to insert before the next one."""
        n = len(self.pending) - len(self.pending.lstrip("I"))
        for _ in range(n):
            self.state = _NEXT[self.state]
            self._put(_NAMES[self.state], "")
        self.cost += INSERT * n
        self.pending = self.pending[n:]

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self._inserts()
        edit, self.pending = self.pending[0], self.pending[1:]
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * (fault == "truncated") + REROLE * (edit == "R")
        if edit == "K" and role[:1] == "s":
            self.state = 1
        else:
            self.state = _NEXT[self.state]
            role = role if edit == "K" else _NAMES[self.state]
        self._put(role, text)

    def done(self) -> tuple:
        if self.audit:
            self.pending += _CLOSING[self.state]
            self.audit.append(_CLOSING[self.state])
            self._inserts()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: gaps in its turns, faults, neighbouring roles that may not follow each other, the least cost of
    a repair, its audit (the edits' initials) and the SHA-256 of the repaired rows, ``role:text`` joined by line feeds."""
    space = F.lit(" ")
    rows = faults(
        conversations.select(
            F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        )
    )
    of_chunks = chunk_audits(rows).select("conv", *_CHUNK_ORDER, F.lit(-1).cast("bigint").alias("at"), "audits", "exits")
    of_rows = rows.select("conv", *_CHUNK_ORDER, "at", "turn", "role", "text", "fault")
    merged = of_rows.unionByName(of_chunks, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", *_CHUNK_ORDER, "at")
    conv_type = dict(rows.dtypes)["conv"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: _Repaired | None = None
        arrow_type = None
        for batch in batches:
            arrow_type = batch["conv"].type
            out = []
            columns = (batch[c].to_pylist() for c in ("conv", "at", "turn", "role", "text", "fault", "audits", "exits"))
            for conv, at, turn, role, text, fault, audits, exits in zip(*columns, strict=True):
                if here is None or conv != here.conv:
                    if here is not None:
                        out.append(here.done())
                    here = _Repaired(conv)
                if at < 0:
                    here.chunk(audits, exits)
                else:
                    here.row(turn, role, text, fault)
            yield _batch(out, arrow_type)
        if here is not None:
            yield _batch([here.done()], arrow_type)

    return merged.mapInArrow(replay, f"conv_id {conv_type}, " + ", ".join(f"{c} bigint" for c in _OUT[1:7]) + ", audit string, repaired_sha256 string")


def _batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _OUT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by a checksum of id and turn: one in twenty each dropped, emptied, without ends of sentences, repeated, or
    given the role user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("_kind"),
    )
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter("_kind <> 0").select("conv_id", "turn", "role", "text", copies.alias("_copy")).drop("_copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    zeros = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _OUT[1:7]]
    empty = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")]
    return every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(F.col("_conv").alias("conv_id"), *zeros, *empty)

"""Alignment of two tokenizers' tokens by diagonal run skipping.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). Where a token of A and a token of B end
at the same byte, a group ends. Most tokens of a stretch are one to one, so their ends agree at one shift of the indices:
probes of doubling length compare the two end arrays at the current shift and jump the stretch; the first place that
differs is walked token by token up to the next common end, which sets the next shift.

Both encoders are applied to stretches between single spaces that have no white space on either side, and remember them.
That gives the tokens of the whole text: A's pattern always starts a token there, and B has no piece in which another
character precedes a space (checked when the vocabulary is read, as is the order of A's merges). Long texts are handled
in segments of ``SEGMENT`` characters, cut at such places, so what a task holds of one text is its numbers only.

Links are counted in batches of documents: the distinct pairs of a batch and the number of its documents that hold them
are Spark rows, summed and joined back by pair; a document keeps positions in its batch's list. So a pair that all
documents share is one row a batch.

Null and empty texts, and texts whose tokens don't give back a space and the text, have no tokens: all numbers zero, no
groups, an empty hash. Repeated rows are documents of their own; rows with null ids are kept. Tables without rows give none.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm.common import table
from readweave.session import cut_lineage

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 8_000_000
SEGMENT = 1_000_000
REMEMBERED = 400_000
PROBE = 8
#: Fixed value: how the byte-level vocabulary cuts text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself if it can be printed, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Aligned:
    """Tokens of both vocabularies, and for each group the number of tokens of A and of B up to its end."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


def common_ends(ea: list[int], eb: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of both sides at each common end. The last ends must be equal."""
    n_a, n_b = len(ea), len(eb)
    i = j = 0
    alone_a: list[int] = []
    alone_b: list[int] = []
    ea, eb = [*ea, -1], [*eb, -2]  # ends that never agree
    while True:
        step = PROBE
        while ea[i : i + step] == eb[j : j + step]:
            i += step
            j += step
            step *= 2
        while step > PROBE:
            step //= 2
            if ea[i : i + step] == eb[j : j + step]:
                i += step
                j += step
        x, y = ea[i], eb[j]
        while x == y:
            i += 1
            j += 1
            x, y = ea[i], eb[j]
        if i >= n_a:
            break
        while x != y:
            if x < y:
                alone_a.append(i)
                i += 1
                x = ea[i]
            else:
                alone_b.append(j)
                j += 1
                y = eb[j]
        i += 1
        j += 1
    return _others(n_a, alone_a), _others(n_b, alone_b)


def _others(n: int, without: list[int]) -> np.ndarray:
    ends = np.ones(n, bool)
    ends[without] = False
    return np.flatnonzero(ends) + 1


class Aligner:
    """Both vocabularies, and stretches met so far: from ``REMEMBERED`` of them, or 20 times as many characters, on those of the last two rounds."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        special = [t for t in model["vocab"] if not all(c in alphabet for c in t) or t == "<|endoftext|>"]
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError(f"merges of {a_file} are not in the order of their ids")
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.b_bytes = [self._piece(i) for i in range(self._b.vocab_size())]
        if any(_BEFORE_SPACE.search(self._b.id_to_piece(i)) for i in range(self._b.vocab_size())):
            raise ValueError(f"pieces of {b_file} cross white space")
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(p) for p in self.b_bytes], np.int64)
        for i, t in self.a_bytes.items():
            self.a_size[i] = len(t)
        self._known: dict[str, tuple[bytes, bytes, bool]] = {}
        self._before: dict[str, tuple[bytes, bytes, bool]] = {}
        self._held = 0

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def _learn(self, stretches: list[str]) -> None:
        """Remember the tokens of a space and each stretch, and whether both give its bytes back."""
        if len(self._known) >= REMEMBERED or self._held >= 20 * REMEMBERED:
            self._known, self._before, self._held = {}, self._known, 0
        self._held += sum(map(len, stretches))
        fresh = []
        for s in stretches:
            found = self._before.get(s)
            if found:
                self._known[s] = found
            else:
                fresh.append(s)
        for s, b in zip(fresh, self._b.encode(fresh, num_threads=1), strict=True):
            whole = " " + s
            a, raw = self._a.encode_ordinary(whole), whole.encode()
            ok = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            self._known[s] = (array("i", a).tobytes(), array("i", b).tobytes(), ok)

    def _encoded(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        at = 0
        while at < len(text):
            cut = _BETWEEN.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            stretches = _BETWEEN.split(text[at : cut.start()] if cut else text[at:])
            got = [*map(self._known.get, stretches)]
            if None in got:
                self._learn([s for s in dict.fromkeys(stretches) if s not in self._known])
                known = self._known
                got = [g or known[s] for g, s in zip(got, stretches, strict=True)]
            yield np.frombuffer(b"".join([g[0] for g in got]), np.int32), np.frombuffer(b"".join([g[1] for g in got]), np.int32), all([g[2] for g in got])
            at = cut.end() if cut else len(text)

    def _gives_back(self, text: str, segments: list[tuple[np.ndarray, np.ndarray, bool]]) -> bool:
        if all(ok for _, _, ok in segments):
            return True
        raw = (" " + text).encode()
        a = b"".join(self.a_bytes[i] for s in segments for i in s[0].tolist())
        return a == raw and b"".join(self.b_bytes[i] for s in segments for i in s[1].tolist()) == raw

    def segments(self, text: str | None) -> Iterator[Aligned]:
        """The parts of a text one after the other, each with its own counts; nothing if the text has no tokens."""
        if not text:
            return
        parts = list(self._encoded(text))
        if not self._gives_back(text, parts):
            return
        if not all(ok for _, _, ok in parts):  # bytes that only the whole gives back: one part
            parts = [(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), True)]
        for a, b, _ in parts:
            ends = common_ends(self.a_size[a].cumsum().tolist(), self.b_size[b].cumsum().tolist())
            yield Aligned(a, b, *ends)

    def align(self, text: str | None) -> Aligned:
        parts = list(self.segments(text))
        if not parts:
            return Aligned(*(np.zeros(0, t) for t in (np.int32, np.int32, np.int64, np.int64)))
        before_a, before_b = np.cumsum([0] + [p.a.size for p in parts]), np.cumsum([0] + [p.b.size for p in parts])
        return Aligned(
            np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts]),
            np.concatenate([p.ends_a + n for p, n in zip(parts, before_a, strict=False)]),
            np.concatenate([p.ends_b + n for p, n in zip(parts, before_b, strict=False)]),
        )


_BEFORE_SPACE = re.compile(f"[^{_SPACE}]{_SPACE}")
_LOADED: dict[tuple[str, str], Aligner] = {}


def _aligner(a_file: str, b_file: str) -> Aligner:
    if (a_file, b_file) not in _LOADED:
        _LOADED[a_file, b_file] = Aligner(a_file, b_file)
    return _LOADED[a_file, b_file]


def align(docs: DataFrame, out: str, text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``docs`` with a column ``out``: the tokens of both vocabularies and the counts of tokens at each group's end.
    All columns and rows of ``docs`` stay; an older column of that name is replaced."""
    fields = ("a", "b", "ends_a", "ends_b")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = _aligner(a_file, b_file)
        for texts in batches:
            found = [aligner.align(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([getattr(f, c) for f in found], pa.list_(pa.int32())) for c in fields], list(fields))

    aligned = F.arrow_udf(run, "struct<" + ",".join(f"{c}:array<int>" for c in fields) + ">")
    return docs.withColumn(out, aligned(F.col(text_col).cast("string")))


class _Digest:
    """What the counts need of aligned segments: written groups and links."""

    def __init__(self, aligner: Aligner) -> None:
        self.width = len(aligner.b_bytes)
        self._n = max(aligner.a_size.size, self.width)
        self._written = pa.array([f"{i}{sep}" for sep in ",|;" for i in range(self._n)], pa.large_string())

    def written(self, s: Aligned) -> memoryview:
        """The groups as ``a1,a2|b1``, joined by ``;``."""
        per_a, per_b = np.diff(s.ends_a, prepend=0), np.diff(s.ends_b, prepend=0)
        code = np.empty(s.a.size + s.b.size, np.int64)
        a, b = s.a.astype(np.int64), s.b.astype(np.int64)
        a[s.ends_a - 1] += self._n
        b[s.ends_b - 1] += 2 * self._n
        code[np.arange(a.size) + np.repeat(s.ends_b - per_b, per_a)] = a
        code[np.arange(b.size) + np.repeat(s.ends_a, per_b)] = b
        taken = self._written.take(pa.array(code))
        _, ends, text = taken.buffers()
        return memoryview(text)[: int(np.frombuffer(ends, np.int64)[code.size]) - 1]

    def links(self, s: Aligned) -> np.ndarray:
        """A number for each linked pair of occurrences: a * width + b."""
        per_a, per_b = np.diff(s.ends_a, prepend=0), np.diff(s.ends_b, prepend=0)
        partners = np.repeat(per_b, per_a)
        first = np.repeat(s.ends_b - per_b, per_a)
        until = partners.cumsum()
        right = np.arange(int(until[-1])) + np.repeat(first - until + partners, partners)
        return np.repeat(s.a.astype(np.int64) * self.width, partners) + s.b[right]


_ROWS = "batch bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, at array<int>, times array<int>, pairs array<struct<a:int,b:int,docs:int>>"


def _counted(a_file: str, b_file: str):
    """Rows of documents, and for each batch of them one row with its pairs."""

    def one(aligner: Aligner, digest: _Digest, text: str | None) -> tuple:
        n_a = n_b = n_groups = n_links = 0
        sha, keys = hashlib.sha256(), []
        for s in aligner.segments(text):
            sha.update(b";" if keys else b"")
            sha.update(digest.written(s))
            links = digest.links(s)
            keys.append(np.unique(links, return_counts=True))
            n_a, n_b, n_groups, n_links = n_a + s.a.size, n_b + s.b.size, n_groups + s.ends_a.size, n_links + links.size
        if not keys:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, times = keys[0]
        if len(keys) > 1:
            pair, where = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
            times = np.bincount(where, np.concatenate([t for _, t in keys])).astype(np.int64)
        return n_a, n_b, n_groups, n_links, sha.hexdigest(), pair, times

    def flush(number: int, ids: list[int | None], rows: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
        pairs, at, docs = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
        ends = pa.array(np.cumsum([0] + [r[5].size for r in rows]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel(), pa.int32())) for x in (at, np.concatenate([r[6] for r in rows]))]
        plain = [[number] * len(rows), ids, *([r[i] for r in rows] for i in range(5))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, _TYPES, strict=False)), *lists, pa.nulls(len(rows), _TYPES[-1])], _NAMES)
        found = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (pairs // width, pairs % width, docs)], ["a", "b", "docs"])
        last = [pa.array([number], pa.int64()), *(pa.nulls(1, t) for t in _TYPES[1:-1]), pa.ListArray.from_arrays([0, len(found)], found)]
        yield pa.RecordBatch.from_arrays(last, _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_file)
        digest = _Digest(aligner)
        number, size = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py()
                ids.append(doc_id.as_py())
                rows.append(one(aligner, digest, t))
                size += len(t or "") + 100
                if size >= BATCH_CHARS:
                    yield from flush(number, ids, rows, digest.width)
                    number, size, ids, rows = number + 1, 0, [], []
        if rows:
            yield from flush(number, ids, rows, digest.width)

    return run


_NAMES = [c.split(" ")[0] for c in _ROWS.split(", ")]
_LIST, _LONG = pa.list_(pa.int32()), pa.int64()
_TYPES = [_LONG, _LONG, _LONG, _LONG, _LONG, _LONG, pa.string(), _LIST, _LIST, pa.list_(pa.struct([(c, pa.int32()) for c in ("a", "b", "docs")]))]
_SUMS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over each document's links of what its batch's pairs got."""
    order = np.argsort(pairs["at"].to_numpy())
    count, best = pairs["n"].to_numpy()[order], pairs["best"].to_numpy()[order]
    at, times = (docs[c].combine_chunks() for c in ("at", "times"))
    where, weight = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
    total = [np.concatenate([[0], np.cumsum(x)]) for x in (weight * best[where], weight * count[where])]
    sums = [pa.array(t[ends[1:]] - t[ends[:-1]], pa.int64()) for t in total]
    return pa.table([*(docs[c] for c in _NAMES[1:6]), *sums, docs["groups_sha256"]], [c.split(" ")[0] for c in _SUMS.split(", ")])


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document: tokens, groups, links, those of them whose pair is the most frequent one of its A id (``n_best``), and the
    sum of their pairs' counts over all documents (``count_sum``), with the hash of the groups as they are written."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut_lineage(texts.mapInArrow(_counted(a_file, b_file), _ROWS))
    pairs = rows.filter("pairs IS NOT NULL").select("batch", F.posexplode("pairs").alias("at", "p")).select("batch", "at", "p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    marked = counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    told = pairs.join(marked, ["a", "b"]).select(F.col("batch").alias("told"), "at", "n", "best")
    kept = rows.filter("pairs IS NULL").drop("pairs")
    return kept.groupBy("batch").cogroup(told.groupBy("told")).applyInArrow(_summed, _SUMS)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"))

"""Repeated passages removed by suffix automata of reference shards.

Words are runs of other bytes than ASCII white space. Each word is removed that lies in a window of ``WINDOW`` words which
also starts in a row with a smaller id. Windows are judged on the input: what is removed elsewhere still counts.

A window's anchor is the ``GRAM``-word run in it with the smallest hash. Equal windows have equal anchors, and a run of
windows with one anchor is a passage of 13 to 19 words. A passage matters only if another row has its anchor, so hashes
of anchors are counted first. What remains goes, once for each group of rows, to the reference shard of its
anchor. There passages stream in the order of their ids past the suffix automaton of all that came before: matching
statistics give, for each window, the state that holds it, and with it the first row that had it. Passages with a window
that is new are added. The groups get the first rows back and cut maximal spans.

An automaton isn't sent to every executor: shards grow in number with the rows, so that each passes only what may match
it. A shard is bounded by ``SHARD_BYTES`` of the input. An anchor that more than ``COMMON`` groups of rows share, as a
common phrase would, goes window by window to shards of the windows, so its neighbourhoods don't meet in one shard.
Groups of rows and buckets of anchors are bounded likewise, whatever the input. Hashes only choose what to compare; words
are compared themselves.

Null ids: such rows keep all words and are no reference. Rows with equal ids don't remove each other's words. Null and empty
texts have no words. Texts of fewer than ``WINDOW`` words stay whole. Repeated rows are judged each by itself. Rows alike
in id and text share a group. Tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from readweave.llm.common import fresh, table

WINDOW = 13
GRAM = 7
GROUP_BYTES = 4_000_000
SHARD_BYTES = 500_000
BUCKET_BYTES = 32_000_000
COMMON = 2000

_FOUND = "n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
_BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_NEVER = np.uint64(2**64 - 1)


class SuffixAutomaton:
    """All substrings of the word runs added, each with the number that came with the run in which it was first seen."""

    def __init__(self) -> None:
        self.following: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.first: list[int] = [-1]

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state for those strings of ``q`` that end a string of ``p``."""
        half = len(self.size)
        self.size.append(self.size[p] + 1)
        self.first.append(self.first[q])
        self.following.append(dict(self.following[q]))
        self.link.append(self.link[q])
        self.link[q] = half
        while p >= 0 and self.following[p].get(word) == q:
            self.following[p][word] = half
            p = self.link[p]
        return half

    def add(self, words: Sequence[bytes], number: int) -> None:
        following, link, size, first = self.following, self.link, self.size, self.first
        p = 0
        for word in words:
            q = following[p].get(word)
            if q is None:
                new, longer = len(size), size[p] + 1
                while p >= 0 and word not in following[p]:
                    following[p][word] = new
                    p = link[p]
                size.append(longer)
                first.append(number)
                following.append({})
                link.append(0)
                if p >= 0:
                    q = following[p][word]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, q, word)
                p = new
            else:
                p = q if size[q] == size[p] + 1 else self._split(p, q, word)

    def first_of(self, words: Sequence[bytes], window: int) -> list[int | None]:
        """For each window of ``words`` the number it was first added with, None if it never was."""
        following, link, size = self.following, self.link, self.size
        state = length = 0
        out: list[int | None] = []
        for i, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                length = size[state]
            to = following[state].get(word)
            if to is not None:
                state, length = to, min(length + 1, window)
                while size[link[state]] >= window:
                    state = link[state]
            if i >= window - 1:
                out.append(self.first[state] if length == window else None)
        return out


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes, in blocks of bytes."""
    out = np.empty(starts.size, np.uint64)
    i = 0
    while i < starts.size:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        forth = np.full(hi - lo + 1, _ODD, np.uint64)
        back = np.full(hi - lo + 1, pow(int(_ODD), -1, 2**64), np.uint64)
        forth[0] = back[0] = 1
        np.multiply.accumulate(forth, out=forth)
        np.multiply.accumulate(back, out=back)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * forth[:-1], out=sums[1:])
        at = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[at]) * back[at]
        i = j
    return _mixed(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Rows:
    """A group of rows and where their words are."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, window: int) -> None:
        self.window = window
        self.known_id = ~ids.is_null().to_numpy()
        self.ids = ids.cast(pa.int64()).fill_null(0).to_numpy()
        self.texts = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        self.all = b"\n".join(self.texts)
        self.data = np.frombuffer(self.all, np.uint8)
        edge = np.diff(np.concatenate([[True], _WHITE[self.data], [True]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.row = np.searchsorted(np.cumsum([len(t) + 1 for t in self.texts]), self.starts, "right")
        self.n_words = np.bincount(self.row, minlength=len(self.texts))

    def passages(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, last window and anchor of each passage, in order of rows."""
        n = self.starts.size - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = _word_hashes(self.data, self.starts, self.ends)
        g = np.zeros(h.size - gram + 1, np.uint64)
        for k in range(gram):
            g = g * _ODD + h[k : k + g.size]
        g = np.minimum(_mixed(g), _NEVER - np.uint64(1))
        g[self.row[: g.size] != self.row[gram - 1 :]] = _NEVER
        least = g[:n].copy()
        for k in range(1, self.window - gram + 1):
            np.minimum(least, g[k : k + n], out=least)
        where = np.zeros(n, np.int64)
        for k in range(self.window - gram, -1, -1):
            where = np.where(g[k : k + n] == least, np.arange(k, k + n), where)
        whole = (self.row[:n] == self.row[self.window - 1 :]) & self.known_id[self.row[:n]]
        where[~whole] = -1
        cut = np.concatenate([[True], where[1:] != where[:-1], [True]])
        first, last = np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:])
        kept = whole[first]
        return first[kept], last[kept], least[first[kept]]

    def words(self, first: int, last: int) -> bytes:
        """The words from window ``first`` to the end of window ``last``, joined by single spaces."""
        return b" ".join(self.all[self.starts[first] : self.ends[last + self.window - 1]].split())


def _distinct(anchor: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors in order, and which of them lie in several rows. ``rows`` are in order."""
    order = np.argsort(anchor, kind="stable")
    found, at = np.unique(anchor[order], return_index=True)
    rows = rows[order]
    return found, rows[at] != rows[np.append(at, rows.size)[1:] - 1]


def repeats(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with a column ``out``: the number of words, how many are removed, the spans removed (of words, half-open, in order)
    and the words kept, joined by single spaces. All columns and rows of ``docs`` stay; an older column of that name is replaced."""
    docs = docs.drop(out)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    grp = fresh("group", docs.columns)
    laid = docs.withColumn(grp, F.pmod(F.xxhash64(id_col, text_col), F.lit(1 + total // GROUP_BYTES)))
    slim = laid.select(id_col, text_col, grp)
    bits = (total // BUCKET_BYTES).bit_length()
    shards = 1 + total // SHARD_BYTES

    def ordered(t: pa.Table) -> pa.Table:
        """Rows of a group come in any order, and each pass must number their words alike."""
        return t.take(pc.sort_indices(t, sort_keys=[(id_col, "ascending"), (text_col, "ascending")]))

    def rows(t: pa.Table) -> _Rows:
        return _Rows(t[id_col], t[text_col].cast(pa.string()), window)

    def gather(t: pa.Table) -> pa.Table:
        found = np.unique(rows(t).passages(gram)[2])
        bucket = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(found.size, np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = [found[i:j].tobytes() for i, j in zip(at, np.append(at, found.size)[1:], strict=True)]
        return pa.table([pa.array([t[grp][0].as_py()] * len(parts), pa.int64()), pa.array(bucket[at], pa.int64()), pa.array(parts, pa.binary())], ["member", "bucket", "anchors"])

    def count(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p.as_buffer(), np.uint64) for p in t["anchors"]]
        _, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        seen = ((n > 1) + 2 * (n > COMMON)).astype(np.uint8)[at.ravel()]
        flags = [x.tobytes() for x in np.split(seen, np.cumsum([p.size for p in parts])[:-1])]
        return pa.table([t["member"], t["bucket"], pa.array(flags, pa.binary())], ["member", "bucket", "flags"])

    def pieces(t: pa.Table, told: pa.Table) -> pa.Table:
        group = rows(ordered(t))
        first, last, anchor = group.passages(gram)
        found, several = _distinct(anchor, group.row[first])
        order = np.argsort(told["bucket"].to_numpy())
        flags = np.frombuffer(b"".join(told["flags"][int(i)].as_py() for i in order), np.uint8)
        mine = np.searchsorted(found, anchor)
        kept = np.flatnonzero(((flags & 1 > 0) | several)[mine])
        common = flags[mine[kept]] & 2 > 0
        held: dict[bytes, tuple[int, int, list[int]]] = {}
        columns = (x[kept].tolist() for x in (first, last, anchor))
        for a, b, hashed, number, by_window in zip(*columns, group.ids[group.row[first[kept]]].tolist(), common.tolist(), strict=True):
            for i, j in [(w, w) for w in range(a, b + 1)] if by_window else [(a, b)]:
                text = group.words(i, j)
                known = held.get(text)
                if known is None:
                    held[text] = ((xxhash.xxh64_intdigest(text) if by_window else hashed) % shards, number, [i])
                else:
                    known[2].append(i)
                    if number < known[1]:
                        held[text] = (known[0], number, known[2])
        columns = [[h[0] for h in held.values()], [h[1] for h in held.values()], [t[grp][0].as_py()] * len(held)]
        at = pa.array([h[2] for h in held.values()], pa.list_(pa.int64()))
        return pa.table([*(pa.array(c, pa.int64()) for c in columns), at, pa.array(list(held), pa.binary())], ["shard", "number", "member", "at", "words"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        same: dict[bytes, bytes] = {}
        told: dict[bytes, list[int]] = {}  # what was found once stays, as ids only rise
        for batch in batches:
            answers = []
            for here, number, text in zip(*(batch[c].to_pylist() for c in ("shard", "number", "words")), strict=True):
                if here != shard:
                    shard, automaton, same, told = here, SuffixAutomaton(), {}, {}
                first = told.get(text)
                if first is None:
                    words = [same.setdefault(w, w) for w in text.split(b" ")]
                    first = automaton.first_of(words, window)
                    if None in first:
                        automaton.add(words, number)
                        first = [number if f is None else f for f in first]
                    told[text] = first
                answers.append(first)
            yield pa.RecordBatch.from_arrays([batch["member"], batch["at"], pa.array(answers, pa.list_(pa.int64()))], ["member", "at", "first"])

    def cut(t: pa.Table, told: pa.Table) -> pa.Table:
        t = ordered(t)
        group = rows(t)
        at, first = (told[c].combine_chunks() for c in ("at", "first"))
        n_at, n_first = (x.value_lengths().to_numpy() for x in (at, first))
        windows = np.repeat(n_first, n_at)  # for each place of a passage its windows, and where their numbers begin
        begin = np.repeat(np.cumsum(n_first) - n_first, n_at)
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        place = np.repeat(at.flatten().to_numpy(), windows) + step
        seen = first.flatten().to_numpy()[np.repeat(begin, windows) + step]
        hits = place[seen < group.ids[group.row[place]]]
        covered = np.zeros(group.starts.size + 1, np.int32)
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + window, -1)
        gone = covered[:-1].cumsum() > 0
        before = np.concatenate([[0], np.cumsum(group.n_words)])
        found = []
        for text, lo, hi in zip(group.texts, before[:-1].tolist(), before[1:].tolist(), strict=True):
            out_here, words = gone[lo:hi], text.split()
            n_removed, spans = int(out_here.sum()), []
            if n_removed:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out_here, [False]])))
                spans = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
                words = [w for w, x in zip(words, out_here.tolist(), strict=True) if not x]
            found.append({"n_words": hi - lo, "n_removed": n_removed, "spans": spans, "kept": b" ".join(words).decode("utf-8", "replace")})
        return t.drop_columns([grp]).append_column(out, pa.array(found, _ARROW))

    asked = slim.groupBy(grp).applyInArrow(gather, "member bigint, bucket bigint, anchors binary")
    flagged = asked.groupBy("bucket").applyInArrow(count, "member bigint, bucket bigint, flags binary")
    passages = slim.groupBy(grp).cogroup(flagged.groupBy("member")).applyInArrow(pieces, "shard bigint, number bigint, member bigint, at array<bigint>, words binary")
    streamed = passages.repartition("shard").sortWithinPartitions("shard", "number")
    answers = streamed.mapInArrow(match, "member bigint, at array<bigint>, first array<bigint>")
    schema = StructType([*docs.schema.fields, StructField(out, StructType.fromDDL(_FOUND))])
    return laid.groupBy(grp).cogroup(answers.groupBy("member")).applyInArrow(cut, schema)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "f")
    return found.select("doc_id", "f.n_words", "f.n_removed", F.sha2(F.col("f.kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
seen AS (SELECT p, min(doc_id) AS earliest FROM win GROUP BY p),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM win JOIN seen USING (p) WHERE earliest < doc_id),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY j) AS text
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n_removed FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""

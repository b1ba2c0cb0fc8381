"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and benchmark items become lower-case words joined by single spaces. Each run of ``window`` words of an item
is a pattern (an item of fewer words is one pattern as a whole), with a space at either end so that it matches whole
words only. A table of blocks tells how far the search may jump, a bucket of patterns belongs to each block that ends a
pattern, and patterns of the bucket are compared byte by byte.

Patterns are kept in classes of similar length: the jump is bounded by the shortest pattern of a class, so one short
item doesn't slow the search for the others. The benchmark is a query set. It is read in blocks of ``BLOCK_BYTES`` of
item text; each block is one pass over the documents, so no more than a block is ever held or sent out at once.

Null texts, empty texts and texts of separators have no words: ``n_words`` 0, no span, no item. Items without words are
ignored. Items with a null id count as one item whose id is written as an empty text. Repeated items count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm.common import fresh, raw, table, unique
from readweave.session import cut_lineage

WINDOW = 10
BLOCK_BYTES = 8_000_000
#: Separators become spaces, upper-case ASCII letters lower case; bytes from 0x80 on belong to words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"

_SEARCHERS: dict[str, WuManber] = {}


class WuManber:
    """Finds all places of many patterns in a byte string."""

    def __init__(self, patterns: list[bytes]) -> None:
        classes: dict[int, list[bytes]] = {}
        for p in dict.fromkeys(patterns):
            classes.setdefault(len(p).bit_length(), []).append(p)
        self.classes = [self._tables(group) for _, group in sorted(classes.items())]

    @staticmethod
    def _tables(patterns: list[bytes]) -> tuple[int, int, dict[bytes, int], dict[bytes, list[bytes]]]:
        reach = min(map(len, patterns))
        block = max(2, min(10, reach // 3))
        jump: dict[bytes, int] = {}
        bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(block, reach + 1):
                b = p[end - block : end]
                jump[b] = min(jump.get(b, reach), reach - end)
            bucket.setdefault(p[reach - block : reach], []).append(p)
        return reach, block, jump, bucket

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Start and pattern of each occurrence, overlapping ones too."""
        for reach, block, jump, bucket in self.classes:
            far, end, size, known = reach - block + 1, reach, len(text), jump.get
            while end <= size:
                here = text[end - block : end]
                step = known(here, far)
                if step:
                    end += step
                    continue
                for p in bucket[here]:
                    if text.startswith(p, end - reach):
                        yield end - reach, p
                end += 1


def item_patterns(text: bytes | None, window: int) -> list[bytes]:
    words = (text or b"").translate(WORDS).split()
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))] if words else []


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[dict[bytes, list[str]]]:
    """Patterns with the ids of the items they come from, in blocks of bounded size."""
    block: dict[bytes, dict[str, None]] = {}
    size = 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), raw(F.col(text_col)).alias("text"))
    for item, text in rows.toLocalIterator():
        for p in item_patterns(bytes(text or b""), window):
            block.setdefault(p, {})[item] = None
        size += len(text or b"")
        if size >= BLOCK_BYTES:
            yield {p: list(ids) for p, ids in block.items()}
            block, size = {}, 0
    yield {p: list(ids) for p, ids in block.items()}


def occurrences(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with a column ``out``: the number of words, the spans of words hit (half-open, merged, in order) and the
    sorted ids of the items that occur. All columns and rows of ``docs`` stay; an older column of that name is replaced."""
    spark = docs.sparkSession
    before = fresh("before", docs.columns)
    df = docs.drop(out)
    for n, block in enumerate(_blocks(benchmark, item_col, bench_text_col, window)):
        if n:
            df = cut_lineage(df.withColumnRenamed(out, before))
            df = df.withColumn(out, _search(spark, block)(raw(F.col(text_col)), F.col(before))).drop(before)
        else:
            df = df.withColumn(out, _search(spark, block)(raw(F.col(text_col)), F.lit(None).cast(FOUND)))
    return df


def _search(spark: SparkSession, block: dict[bytes, list[str]]):
    sent, key = spark.sparkContext.broadcast(block), unique("patterns")

    def search(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        items = sent.value
        if key not in _SEARCHERS:
            _SEARCHERS[key] = WuManber(list(items))
        for batch, before in texts:
            yield pa.array([_found(_SEARCHERS[key], items, t.as_py(), b.as_py()) for t, b in zip(batch, before, strict=True)], _TYPE)

    return F.arrow_udf(search, FOUND).asNondeterministic()


_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _found(searcher: WuManber, items: dict[bytes, list[str]], text: bytes | None, before: dict | None) -> dict:
    words = (text or b"").translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    ids = set(before["items"] if before else ())
    hit = [(s["start"], s["end"]) for s in before["spans"]] if before else []
    starts = None
    for at, pattern in searcher.find(line):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        first = int(np.searchsorted(starts, at))
        hit.append((first, first + pattern.count(b" ") - 1))
        ids.update(items[pattern])
    spans: list[dict[str, int]] = []
    for a, b in sorted(hit):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(b, spans[-1]["end"])
        else:
            spans.append({"start": a, "end": b})
    return {"n_words": len(words), "spans": spans, "items": sorted(ids)}


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    found = fresh("found", docs.columns)
    return occurrences(docs, benchmark, found).filter(F.size(F.col(found)["items"]) == 0).select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = occurrences(docs, table(spark, sf_dir, "benchmark"), "f").select("doc_id", "f.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return f.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = """
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS p, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
runs AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM pat) WHERE len(w) >= k)),
hits AS (SELECT r, i, runs.k, item_id FROM runs JOIN pat USING (p, k)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` places. Each shard owns ``NODES`` virtual nodes on it; a row's key hashes to a place and belongs to
the next node clockwise. A shard takes rows up to its load bound, in ring order; rows beyond it continue clockwise to the
next node whose shard has room, until all are placed. The bounds are the even shares, so row counts differ by one at most
(law ``rows``), and a further shard moves little more than the rows it gets.

Where rows overflow depends on counts of places alone. So Spark counts the rows of each place (at most ``CELLS`` rows
come to the driver, whatever the input), the walk round the ring runs over these counts, and its outcome, a list of rank
ranges for each place, is joined back by place: its length is bounded by places, shards and nodes. The only shuffle of
rows is the one that ranks rows within their place.

Rows with null keys have places like others. Rows equal in all key columns share a place and take consecutive slots; which
of them gets which is open, as they can't be told apart by the key. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readweave.llm.common import fresh, table
from readweave.session import cut_lineage

SHARDS = 8
CELL_BITS = 14
CELLS = 1 << CELL_BITS
NODES = 128


def ring(shards: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, clockwise. Nodes of a further shard never move older ones."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(NODES):
            place = xxhash.xxh64_intdigest(f"shard {shard} node {node}") >> (64 - CELL_BITS)
            while place in taken:
                place = (place + 1) % CELLS
            taken[place] = shard
    return sorted(taken.items())


def placed(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, slot of the first rank) for all rows counted."""
    nodes = ring(shards)
    total = sum(counts.values())
    bound = [total // shards + (s < total % shards) for s in range(shards)]
    load = [0] * shards
    waiting: list[tuple[int, int, int, int]] = []
    at = 0
    for place in sorted(counts):
        while at < len(nodes) and nodes[at][0] < place:
            at += 1
        waiting.append((place, 0, counts[place], at % len(nodes)))
    out = []
    while waiting:
        over = []
        for place, lo, hi, node in waiting:
            shard = nodes[node][1]
            mid = min(hi, lo + bound[shard] - load[shard])
            if mid > lo:
                out.append((place, lo, mid, shard, load[shard]))
                load[shard] += mid - lo
            if mid < hi:
                over.append((place, mid, hi, node))
        waiting = []
        for place, lo, hi, node in over:
            while load[nodes[node][1]] >= bound[nodes[node][1]]:
                node = (node + 1) % len(nodes)
            waiting.append((place, lo, hi, node))
    return out


def assign(docs: DataFrame, key: Sequence[str], shards: int = SHARDS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``docs`` with its shard and its slot in it (0, 1, ... within each shard). Older columns of these names are replaced.

    ``docs`` is evaluated twice, so give a table or a frame that is cheap to read again."""
    spark = docs.sparkSession
    docs = docs.drop(shard_col, slot_col)
    pos, cell, rank, lo, hi, first = (fresh(x, docs.columns) for x in ("pos", "cell", "rank", "lo", "hi", "first"))
    keyed = docs.withColumn(pos, F.xxhash64(*key)).withColumn(cell, F.shiftrightunsigned(pos, 64 - CELL_BITS).cast("int"))
    counts = {r[0]: r[1] for r in keyed.groupBy(cell).count().collect()}
    ranges = spark.createDataFrame(placed(counts, shards), f"{cell} int, {lo} bigint, {hi} bigint, {shard_col} int, {first} bigint")
    order = Window.partitionBy(cell).orderBy(pos, *key)
    ranked = keyed.withColumn(rank, F.row_number().over(order).cast("bigint") - 1)
    got = ranked.join(F.broadcast(ranges), cell).filter((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    return got.withColumn(slot_col, F.col(first) + F.col(rank) - F.col(lo)).select(*docs.columns, shard_col, slot_col)


def shard_documents(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, whole texts included, with ``shard`` and ``slot``."""
    return assign(docs, ["doc_id", "text"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    return assign(cut_lineage(sized), ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

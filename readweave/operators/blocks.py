"""Cutting pieces out of long sequences without carrying whole sequences per row.

Sequences are cut into fixed blocks once. A request joins only the block it starts in, on
(tid, block), so a row carries a few hundred bases and the requests of one long or popular
sequence spread over many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.functions.dna import padded_slice

BLOCK = 256


def chunks(seq: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, in one pass over the text."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def sequence_blocks(seqs: DataFrame, block: int, key: str = "tid", ahead: int = 1) -> DataFrame:
    """key, _blk, _text: every block followed by the next ``ahead`` blocks."""
    pieces = seqs.select(key, chunks(F.col("seq"), block).alias("_c"))
    text = lambda i: F.concat_ws("", *[F.get("_c", i + k) for k in range(ahead + 1)])
    rows = F.transform(F.sequence(F.lit(0), F.size("_c") - 1), lambda i: F.struct(i.alias("_blk"), text(i).alias("_text")))
    kept = pieces.select(key, F.when(F.size("_c") > 0, rows).alias("_rows"))
    # outer: the inner form repeats the whole array expression in a filter below it
    return kept.select(key, F.explode_outer("_rows").alias("_b")).select(key, "_b._blk", "_b._text")


def add_slice(df: DataFrame, seqs: DataFrame, start: Column, span: Column, out: str, longest: int, key: str = "tid") -> DataFrame:
    """Add ``out``: ``span`` bases from ``start`` of the row's sequence, N outside of it.

    ``longest`` is an upper limit of span in this frame; blocks are made at least that long, so
    a block and its successor hold every requested piece.
    """
    block = max(BLOCK, longest)
    # pieces that begin before the sequence are found from its first block
    x = df.withColumn("_at", start.cast("int")).withColumn("_span", span.cast("int"))
    x = x.withColumn("_blk", F.greatest(F.floor(F.col("_at") / block), F.lit(0)).cast("int"))
    blocks = sequence_blocks(seqs, block, key)
    j = x.join(blocks, [key, "_blk"], "left")
    local = F.col("_at") - F.col("_blk") * block
    return j.withColumn(out, padded_slice(F.upper(F.coalesce("_text", F.lit(""))), local, F.col("_span"))).drop("_at", "_span", "_blk", "_text")


def long_slices(df: DataFrame, seqs: DataFrame, row_keys: list[str], key: str, start: str, end: str, block: int = 65_536) -> DataFrame:
    """row_keys, _piece: bases start..end (1-based, inclusive) of the keyed sequence.

    A request takes just the blocks it touches and they are put together per request. Requests
    for an unknown sequence have no row.
    """
    first, last = F.floor((F.col(start) - 1) / block), F.floor((F.col(end) - 1) / block)
    asked = df.select(*row_keys, key, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("_blk"))
    blocks = sequence_blocks(seqs, block, key, ahead=0)
    known = asked.join(seqs.select(key).distinct(), key, "left_semi")
    cut = known.join(blocks, [key, "_blk"], "left").withColumn("_text", F.coalesce("_text", F.lit(""))).withColumn("_from", F.greatest(F.col("_s") - F.col("_blk") * block, F.lit(1)))
    size = F.col("_e") - F.col("_blk") * block - F.col("_from") + 1
    cut = cut.withColumn("_part", F.substring("_text", F.col("_from").cast("int"), size.cast("int")))
    g = cut.groupBy(*row_keys).agg(F.array_sort(F.collect_list(F.struct("_blk", "_part"))).alias("_p"))
    return g.select(*row_keys, F.concat_ws("", F.transform("_p", lambda p: p["_part"])).alias("_piece"))

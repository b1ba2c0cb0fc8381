"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources by code point (null last) weigh 5, 2, 1, 5, 2, 1, ... and share ``SHARE`` of all words; a target stops at
``CAP`` times its source's words and the excess goes to the others by weight.

Schedule: the mix is a row of slots of ``BLOCK`` words. Slot i takes the golden-ratio point frac(i * phi), which falls into
one source's part of [0, 1), parts being proportional to targets. So every stretch of the mix, not only the whole of it,
is near the target weights. A source's documents, in a shuffled order, form one stream of words that is cut into blocks
of equal size; when it ends it begins again, up to ``CAP`` times. The source's r-th slot takes its r-th block.

Slots are ranked and streams are summed in two levels, within short chunks and over chunks, so a source with a third of
all rows is spread like any other. Only tables with a row for each source, or each source and chunk, have windows by
source. All steps are DataFrame operations.

Null texts, empty texts and texts of white space have size 0 and are never taken. Null sources are one source, the last.
Rows equal in all columns are separate rows that are taken apart. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readweave.llm.common import fresh, row_key, table
from readweave.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 64
WORD = "[^\\x20\\x09-\\x0D]+"
GOLDEN = (math.sqrt(5) - 1) / 2
#: Of n golden-ratio points, a part p of [0, 1) gets p * n, give or take 3 + 3.53 * ln(n) (Niederreiter's bound): under 160 for n up to
#: 2**63. Words that begin so many blocks beyond a target can't be taken.
SPREAD = 160
#: Cells of [0, 1) by which slots meet sources, slots in a chunk, hex digits of a document chunk: sizes of pieces of work, not limits.
GUIDE, SLOT_CHUNK, CHUNK_DIGITS = 1024, 1 << 15, 3


def size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: ``source, idx, weight, source_size, target, lo, hi``; lo to hi is its part of [0, 1)."""
    whole = Window.partitionBy()
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = by_source.withColumn("idx", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    limited = by_source.withColumns({"weight": weight, "limit": CAP * F.col("source_size"), "total": SHARE * F.sum("source_size").over(whole)})
    # By rising limit for a unit of weight, a source is at its limit if the sources up to it leave each unit that much.
    by_need = whole.orderBy(F.col("limit") / F.col("weight"), "idx")
    before = F.coalesce(F.sum("limit").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    full = limited.withColumn("full", F.col("limit") * rest <= (F.col("total") - before) * F.col("weight"))
    over = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(whole)
    unit = F.try_divide(over, F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(unit * F.col("weight"))
    so_far = F.sum("target").over(whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    part = full.withColumn("target", target).withColumn("hi", F.coalesce(F.try_divide(so_far, F.col("total")), F.lit(0.0)))
    part = part.withColumn("lo", F.coalesce(F.lag("hi").over(whole.orderBy("idx")), F.lit(0.0)))
    last = F.col("idx") == F.max("idx").over(whole)
    return part.select("source", "idx", "weight", "source_size", "target", "lo", F.when(last, 1.0).otherwise(F.col("hi")).alias("hi"))


def slots(spark: SparkSession, sources: DataFrame, n: int) -> DataFrame:
    """``slot, idx, rank``: slot of the mix, its source, and how many slots of that source come before it."""
    point = F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN)
    at = spark.range(n).select(F.col("id").alias("slot")).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * GUIDE))
    ends = sources.filter("hi > lo").select("idx", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * GUIDE), F.least(F.floor(F.col("hi") * GUIDE), F.lit(GUIDE - 1)))).alias("cell"))
    of = at.join(ends, "cell").filter("u >= lo AND u < hi").select("slot", "idx", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    ahead = of.groupBy("idx", "chunk").agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("ahead", F.sum("n").over(Window.partitionBy("idx").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = of.withColumn("rank", F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")) - 1)
    return ranked.join(ahead, ["idx", "chunk"]).select("slot", "idx", (F.col("rank") + F.col("ahead")).alias("rank"))


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``row, doc_id, idx, source_size, size, start``: where each document begins in its source's shuffled stream."""
    src = sources.select(F.col("source").alias("of"), "idx", "source_size")
    key = F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"), F.col("size").cast("string")).cast("binary"))
    docs = sized.filter("size > 0").join(src, F.col("source").eqNullSafe(F.col("of"))).withColumn("key", key)
    docs = docs.withColumn("chunk", F.substring("key", 1, CHUNK_DIGITS)).select("row", "doc_id", "idx", "source_size", "size", "key", "chunk")
    ahead = docs.groupBy("idx", "chunk").agg(F.sum("size").alias("words"))
    ahead = ahead.withColumn("ahead", F.sum("words").over(Window.partitionBy("idx").orderBy("chunk")) - F.col("words")).drop("words")
    order = Window.partitionBy("idx", "chunk").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    within = docs.withColumn("within", F.sum("size").over(order) - F.col("size"))
    return within.join(ahead, ["idx", "chunk"]).select("row", "doc_id", "idx", "source_size", "size", (F.col("within") + F.col("ahead")).alias("start"))


def schedule(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The mix: for each slot the runs of words that it takes, ``slot, idx, rank, row, doc_id, epoch, first_word, n_words``.

    ``sized`` has ``row, doc_id, source, size`` and, like ``sources``, is a written table: both are read more than once."""
    spark = sized.sparkSession
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    every = slots(spark, sources, math.ceil(total / BLOCK))
    starts = streams(sized, sources).join(sources.select("idx", "target"), "idx").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))))
    start = F.col("start") + F.col("epoch") * F.col("source_size")
    starts = starts.withColumn("start", start).filter(F.col("start") <= F.col("target") + SPREAD * BLOCK).withColumn("end", F.col("start") + F.col("size"))
    pieces = starts.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))))
    lo, hi = F.greatest("start", F.col("rank") * BLOCK), F.least("end", (F.col("rank") + 1) * BLOCK)
    pieces = pieces.select("idx", "rank", "row", "doc_id", "epoch", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("n_words"))
    return every.join(pieces, ["idx", "rank"])


def taken(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Words taken of each row of ``sized``: ``row, taken``, rows of which nothing is taken left out."""
    return schedule(sized, sources).groupBy("row").agg(F.sum("n_words").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: each row as often as the mix takes its words, rounded to whole
    copies. The schedule takes a stream from its start on, so that rounding concerns one document of a source."""
    row = fresh("row", docs.columns)
    kept = cut_lineage(row_key(docs, row))
    sized = cut_lineage(kept.select(F.col(row).alias("row"), "doc_id", "source", size("text").alias("size")))
    copies = taken(sized, cut_lineage(targets(sized))).join(sized, "row").select(F.col("row").alias(row), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(f"{row}n"))
    mixed = kept.join(copies.filter(F.col(f"{row}n") > 0), row)
    return mixed.withColumn(f"{row}n", F.explode(F.sequence(F.lit(1), F.col(f"{row}n")))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut_lineage(row_key(docs.select("doc_id", "source", size("text").alias("size")), "row"))
    sources = cut_lineage(targets(sized))
    src = sources.select(F.col("source").alias("of"), "source_size", "target")
    out = sized.join(src, F.col("source").eqNullSafe(F.col("of"))).join(taken(sized, sources), "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


ORACLE_SQL = f"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, idx, source_size, [5, 2, 1][(idx % 3) + 1] AS weight, 2 * source_size AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM sized GROUP BY source)),
cut AS (
  SELECT *, lim * sum(weight) OVER (ORDER BY lim / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS full_up FROM src),
tgt AS (
  SELECT *, CASE WHEN full_up THEN lim::DOUBLE ELSE (total - sum(CASE WHEN full_up THEN lim ELSE 0 END) OVER ())::DOUBLE
                   / (sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ())::DOUBLE * weight END AS target FROM cut),
part AS (
  SELECT *, coalesce(sum(target) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS lo,
         CASE WHEN idx = max(idx) OVER () THEN 1 ELSE sum(target) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / total END AS hi FROM tgt),
slot AS (
  SELECT slot, idx, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, slot * {GOLDEN!r}::DOUBLE - floor(slot * {GOLDEN!r}::DOUBLE) AS u
        FROM (SELECT unnest(range(0, (SELECT ceil(sum(target) / {BLOCK})::BIGINT FROM tgt))) AS slot)) JOIN part ON u >= lo AND u < hi),
stream AS (
  SELECT r, idx, source_size, size, sum(size) OVER (PARTITION BY idx ORDER BY md5(concat_ws('|', 'mix', doc_id, size)), doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM sized JOIN part ON sized.source IS NOT DISTINCT FROM part.source WHERE size > 0),
piece AS (
  SELECT r, idx, first, first + size AS past, unnest(range(first // {BLOCK}, (first + size - 1) // {BLOCK} + 1)) AS rank
  FROM (SELECT r, idx, size, (start + e * source_size)::BIGINT AS first FROM stream, (VALUES (0), (1)) AS epochs(e))),
got AS (SELECT r, sum(least(past, (rank + 1) * {BLOCK}) - greatest(first, rank * {BLOCK}))::BIGINT AS taken FROM piece JOIN slot USING (idx, rank) GROUP BY r)
SELECT doc_id, size, part.source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM sized JOIN part ON sized.source IS NOT DISTINCT FROM part.source LEFT JOIN got USING (r)
"""

"""Text lines with their position, and the flag header of pipeline files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``value`` and contiguous 0-based ``row_idx`` in file order, without shuffling the lines.

    Ids rise within an input split, so a line's index is its distance from the first id of its
    split plus the lines of all earlier splits. Only the table of splits is sorted; it has a row for every 128 MB or so
    and goes to all tasks.
    """
    raw = (
        spark.read.options(**options)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    splits = raw.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return raw.join(F.broadcast(starts), ["_file", "_block"]).select(
        "value", (F.col("_id") - F.col("_first") + F.col("_start")).alias("row_idx")
    )


def reindex(df: DataFrame, order: str, out: str) -> DataFrame:
    """Replace a gappy ordinal by a contiguous 0-based one.

    Rows are counted in blocks of the ordinal first, so no task sees more than one block.
    """
    block = F.floor(F.col(order) / 100_000)
    blocked = df.withColumn("_blk", block)
    counts = blocked.groupBy("_blk").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_blk", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_s"))
    rank = F.row_number().over(Window.partitionBy("_blk").orderBy(order)) - 1
    return blocked.withColumn("_r", rank).join(starts, "_blk").withColumn(out, F.col("_s") + F.col("_r")).drop("_blk", "_r", "_s")


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines that are not comments, with contiguous ``line`` numbers.

    Files of this family carry comments only at the top; comment or empty lines further down
    are allowed and simply do not count.
    """
    lines = read_lines(spark, path)
    keep = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return reindex(keep, "row_idx", "line").select("value", "line")


_NUMBER = re.compile(r"[+-]?\d+")


def parse_header(lines: list[str]) -> dict[str, int | None]:
    """Flags of leading ``#`` lines: each word is a flag, a number after it is its value.

    The first word of a line is skipped, a later number replaces an earlier one and a bare
    repetition does not. A following word counts as a number when it is wholly numeric or
    starts with a non-zero number, which is then consumed.
    """
    flags: dict[str, int | None] = {}
    for line in lines:
        if not line.strip():
            continue
        if not line.startswith("#"):
            break
        words = line.split()
        i = 1
        while i < len(words):
            flags.setdefault(words[i], None)
            if i + 1 < len(words):
                m = _NUMBER.match(words[i + 1])
                if m and (int(m.group()) != 0 or m.end() == len(words[i + 1])):
                    flags[words[i]] = int(m.group())
                    i += 1
            i += 1
    return flags


def read_header(spark: SparkSession, path: str) -> dict[str, int | None]:
    """Header of a file, or of the first part file of a folder: all lines before the first line of data."""
    first = sorted(spark.read.text(path).inputFiles())[0]
    lines: list[str] = []
    for row in spark.read.text(first).toLocalIterator():
        if row.value.strip() and not row.value.startswith("#"):
            break
        lines.append(row.value)
    return parse_header(lines)


def number(token: Column) -> Column:
    """Double from text; NULL when it is not a number."""
    return token.try_cast("double")

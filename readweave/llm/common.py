"""What several operators share: tables, byte-level words, column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters to lower case; all other bytes, so all other characters too, stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(label: str, taken: Iterable[str] = ()) -> str:
    """A column name that no input column has."""
    name = f"_{label}"
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def raw(text: Column) -> Column:
    """The text as UTF-8 bytes, the form in which Python functions get it."""
    return text.cast("string").cast("binary")


def unique(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


def row_key(df: DataFrame, name: str) -> DataFrame:
    """A number for each row. Only fixed once the frame is written, so callers cut the lineage right after it."""
    return df.withColumn(name, F.monotonically_increasing_id())

"""Session helpers: a local test session and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "readweave", cores: str = "8", shuffle_partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own session. ``scratch``: their ``spark.checkpoint.dir``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return (builder.config("spark.checkpoint.dir", scratch) if scratch else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="readweave-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


#: Tasks that grouping of fragments is dealt to at least.
TASKS = 96


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by key to at least ``TASKS`` tasks, so that few shuffle partitions don't make a task's tables large.

    (Up to 200 partitions are written as they come; more would be sorted first.)
    """
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: With this setting Spark deletes the shuffle files of a query as it ends; else they stay until the driver's memory is cleaned.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For writes whose result is read back: what they shuffled is deleted with their end."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, survives executor loss. What the write shuffled is deleted.

    (A reliable checkpoint would compute the frame a second time for the write.)
    """
    path = scratch_path(df.sparkSession, "stage")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`cut_lineage` wrote for these very frames, once nothing reads them any more."""
    for df in frames:
        path = df.__dict__.pop("_scratch", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)

"""Bounded samples of labelled rows to train from."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitted_on_sample[Model](docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], size: int, train: Callable[[list[str], list[int], float], Model]) -> Model:
    """What ``train`` makes of texts, their labels, and the share of label 1 among all labelled rows. It runs in one task, as the
    sample is bounded: at most ``rows[k]`` of label k (the first by a hash of the id) and at most ``size`` bytes of texts.
    Rows with null ids, labels or texts are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    first = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[k]) for k in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # as many ids as ``rows`` allows
    text = F.col("text").cast("string")
    got = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("bytes")).filter("text IS NOT NULL").join(chosen, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    ends = got.select("bytes", "label", *(c.alias(f"o{i}") for i, c in enumerate(order))).orderBy("o0", "o1", "o2").limit(2 * sum(rows.values())).collect()
    fits, total = 0, 0
    for r in ends:
        total += r["bytes"]
        if total > size:
            break
        fits += 1
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if not fits:
        return train([], [], share)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        kinds: list[int] = []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            kinds += batch.column("label").to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, kinds, share))], pa.binary())], ["model"])

    sample = got.orderBy(*order).limit(fits).select("text", "label")
    return pickle.loads(sample.mapInArrow(learn, "model binary").first()["model"])

"""The pipeline against a plain version of every stage."""

import re
from collections import Counter

import corpus_pipeline
from readweave.llm import mixing, toxicity
from test_decontaminate import plain as plain_hits
from test_mixing import plain_targets
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    after = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, SF).write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        after[name] = kept.collect()
        assert name == "sharding" or kept.columns == columns
    rows = docs.collect()
    model = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    civil = [r for r in rows if model.scores([r["text"] or ""], {})[0] < 0.5]
    assert sorted(r["doc_id"] for r in after["toxicity"]) == sorted(r["doc_id"] for r in civil)
    group = {d: c for d, _, c in plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in civil])}
    single = [r for r in civil if group[r["doc_id"]] == r["doc_id"]]
    assert sorted(r["doc_id"] for r in after["near-duplicates"]) == sorted(r["doc_id"] for r in single)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r in single if not plain_hits(r["text"], items)[1]]
    assert sorted(r["doc_id"] for r in after["decontamination"]) == sorted(r["doc_id"] for r in clean)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    sizes, mixed = Counter(), Counter()
    for r in clean:
        sizes[r["source"]] += size(r)
    for r in after["mixing"]:
        mixed[r["source"]] += size(r)
    copies = Counter(r["doc_id"] for r in after["mixing"])
    assert copies.keys() <= {r["doc_id"] for r in clean} and max(copies.values()) <= 2
    longest = max(map(size, clean))
    assert all(abs(mixed[s] - t) <= longest + 4 * mixing.BLOCK for s, t in plain_targets(sizes).items())
    last = after["sharding"]
    assert Counter((r["doc_id"], r["text"]) for r in last) == Counter((r["doc_id"], r["text"]) for r in after["mixing"])
    shards = Counter(r["shard"] for r in last)
    assert max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(r["slot"] for r in last if r["shard"] == k) == list(range(n)) for k, n in shards.items())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(got.columns)
    assert got.count() > 0

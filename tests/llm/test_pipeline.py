"""The pipeline against its stages written out plainly, as far as they are not a matter of chance."""

from __future__ import annotations

import plain
import pyarrow as pa

import corpus_pipeline
from tidewater.llm import quality


def test_stages(spark, tables):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    made = corpus_pipeline.run(spark, tables)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    rows = made.collect()
    judged = dict(zip(docs, quality.judge(pa.array([d["text"] for d in docs.values()])).to_pylist(), strict=True))
    kept = {k: d for k, d in docs.items() if judged[k]["kept"]}
    groups = plain.components([(k, d["text"]) for k, d in kept.items()], 5, 80)
    alone = {k for k, (n, c) in groups.items() if n == 0 or c == k}
    share = {k: plain.contamination(docs[k]["text"], items, 10) for k in alone}
    clean = {k for k, (n, hit, _) in share.items() if 100 * hit <= 50 * n}
    times: dict[int, int] = {}
    for r in rows:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        if not share[r["doc_id"]][1]:
            assert r["text"] == docs[r["doc_id"]]["text"]
        else:
            assert plain.contamination(r["text"], items, 10)[1] < share[r["doc_id"]][1]
        assert r["n_chars"] == len(r["text"])
    assert set(times) <= clean and max(times.values()) <= 3
    sizes: dict[str, int] = {}
    by: dict[int, list[int]] = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(len(by.get(i, ())) for i in range(40)) <= 1


def test_stages_one_by_one(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, tables)
        assert set(docs.columns) <= set(after.columns), name
        none = stage(spark, docs.limit(0), tables)
        assert none.count() == 0, name


def test_entry_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))

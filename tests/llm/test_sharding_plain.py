"""The sharding query against its contract, ties, and ids that hold a third of all rows."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.llm import sharding


def test_query(spark, tables):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}
    made = sharding.op1_sharding(spark, tables).collect()
    assert sorted(r["doc_id"] for r in made) == sorted(docs)
    for r in made:
        raw = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    counts = Counter(r["shard"] for r in made)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in made) == [(s, k) for s in range(40) for k in range(counts[s])]


def placed(df, **options):
    return {(r["doc_id"], r["text"], r["x"]): (r["shard"], r["slot"]) for r in sharding.shard(df, 7, seed=3, **options).collect()}


@pytest.fixture(scope="module")
def ties(spark):
    rows = [(i % 40, "same text", i) for i in range(400)] + [(None, "t", i) for i in range(30)] + [(1000 + i, None, i) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, x int")


def test_order_does_not_depend_on_partitions(ties):
    assert placed(ties.repartition(1)) == placed(ties.repartition(5, "x")) == placed(ties.coalesce(2).orderBy("x"))


def test_hot_ids_are_spread(spark, monkeypatch):
    rows = [(i % 3 and i, "a", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(4)
    monkeypatch.setattr(sharding, "LEAST", 8)
    made = sharding.shard(df, 10, min_buckets=64)
    counts = Counter(r["shard"] for r in made.collect())
    assert sum(counts.values()) == 6000 and max(counts.values()) - min(counts.values()) <= 1
    assert made.select("shard", "slot").distinct().count() == 6000 and made.select("x").distinct().count() == 6000
    tasks = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert tasks < 2000


def test_columns_that_have_no_hash(spark):
    df = spark.createDataFrame([(i, "t", {"a": i}, [i], (i, {"b": 1})) for i in range(50)], "doc_id long, text string, m map<string,int>, l array<int>, s struct<p:int,q:map<string,int>>")
    assert sorted(r["m"]["a"] for r in sharding.shard(df, 3).collect()) == list(range(50))


def test_very_long_text(spark):
    df = spark.createDataFrame([(i, "x" * (5_000_000 if i == 3 else 10)) for i in range(20)], "doc_id long, text string")
    assert sorted(r["n"] for r in sharding.shard(df, 2, bucket_bytes=1 << 20).select(F.length("text").alias("n")).collect())[-1] == 5_000_000

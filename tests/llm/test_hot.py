"""The join on hot texts keeps every row, and deals rows of one text to several tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.llm import components, hot, jaccard, urls


def test_hot_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(hot, "SOME", 20)
    rows = [(i, "hot" if i % 3 else f"t{i}", i, i, i, i, None) for i in range(900)] + [(-1, None, 1, 1, 1, 1, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, parts int, h1 int, _turn int, j string").repartition(3)
    body = F.coalesce("text", F.lit(""))
    judged = df.select(body.alias("t")).distinct().select(F.xxhash64("t", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "t").alias("k2"), F.length("t").alias("size"))
    monkeypatch.setattr(hot, "SHARE", 40)
    both = hot.with_rows(df, "text", "out", judged, 950)
    got = both.select(F.col("d.doc_id"), F.col("d.text"), F.col("d.n"), F.col("j.size"), F.spark_partition_id().alias("at"))
    made = got.collect()
    assert sorted(r["doc_id"] for r in made) == sorted(r[0] for r in rows)
    assert all(r["size"] == len(r["text"] or "") for r in made)
    assert len({r["at"] for r in made if r["text"] == "hot"}) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_repeated_rows_of_representatives(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1)] * 200 + [(3, text + " x", 2)] * 50 + [(None, text, 3)] * 10 + [(9, "  ", 4)] * 3 + [(10, None, 5)] * 2
    kept = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string, similar int").repartition(4))
    assert sorted((r["doc_id"], r["similar"]) for r in kept.collect()) == [(3, 2), (9, 4), (9, 4), (9, 4), (10, 5), (10, 5)]


def test_held_out_urls(spark):
    import random

    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
    rows = [(f"http://{word('abcdef')}.org/{word('abcdefg')}",) for _ in range(300)] + [(f"http://{word('uvwxyz')}.com/de/{word('tuvwxyz')}",) for _ in range(300)]
    got = urls.held_out(spark.createDataFrame(rows, "url string"), urls.RULES)
    assert got["balanced"] > 0.95 and min(got.values()) > 0.9


def test_components_of_a_plain_table(spark):
    labels = spark.range(4).select(F.col("id").alias("v"), F.col("id").alias("label"))
    links = spark.createDataFrame([(0, 3)], "a long, b long")
    assert {r["v"]: r["label"] for r in components.components(labels, links).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}

"""Streams give what batches give, once all input is in."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewater.streaming import boards

START = datetime(2024, 1, 1)


def test_reservations_expire(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    log = [("a", "reserve", at(0)), ("b", "reserve", at(1)), ("b", "confirm", at(3)), ("c", "reserve", at(2)), ("c", "release", at(4)), ("c", "reserve", at(5)), ("z", "reserve", at(100))]
    for i, part in enumerate((log[:4], log[4:], [("z", "confirm", at(101)), ("y", "reserve", at(200))])):
        spark.createDataFrame(part, "id string, op string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("id string, op string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = boards.drained(boards.expiring(stream, "id", "op", "ts", 10), "append").collect()
    assert sorted((r[0], r[1].timestamp()) for r in got) == [("a", at(10).timestamp()), ("c", at(15).timestamp())]


def test_retries_count_once(spark, tmp_path):
    rows = [(i % 10, START + timedelta(seconds=i)) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    stream = boards.event_stream(spark, str(tmp_path / "events.parquet"))
    assert boards.drained(boards.once(stream).select("event_id"), "append").agg(F.count(F.lit(1))).first()[0] == 10

"""Streaming queries, drained over the table of events; batch SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import boards as S
from .base import Book

BOOK = Book()


@BOOK.add("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, user_id, max(value) AS score FROM events GROUP BY 1, 2")
def stream_weekly_board(spark, d):
    return S.drained(S.weekly_best(S.event_stream(spark, f"{d}/events.parquet"), "user_id", "value"), "complete")


@BOOK.add("SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def stream_dedup(spark, d):
    """Every event is delivered twice and counted once."""
    stream = S.event_stream(spark, f"{d}/events.parquet")
    twice = stream.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.drained(S.once(twice, late=None).select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))

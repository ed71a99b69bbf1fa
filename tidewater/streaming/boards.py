"""Boards and reservations over unbounded streams: dedup under a watermark, weekly windows, event-time timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder

#: Windows of a week start on Monday; the epoch began on a Thursday.
MONDAY = "4 days"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Events as they arrive as Parquet files; ts becomes TIMESTAMP, since watermarks need it."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, event_id: str = "event_id", ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Each event once, if its retries come within ``late``; the state is dropped with the watermark, and so are events older than it.

    With ``late`` None nothing is too late, in whatever order events come: the state keeps every event_id, as draining a whole table needs.
    """
    if late is None:
        return stream.dropDuplicates([event_id])
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])


def weekly_best(stream: DataFrame, member: str, score: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """The weekly board: the greatest score of each member and week. Late lower scores change nothing.

    ``late``: how long after its end a week is still kept; then its state goes. None keeps all weeks, as draining a whole table needs.
    """
    stream = stream.withWatermark(ts, late) if late else stream
    week = F.window(F.col(ts), "7 days", startTime=MONDAY)
    return stream.groupBy(week.alias("week"), member).agg(F.max(score).alias("score")).select(F.date_format("week.start", "yyyy-MM-dd").alias("week"), member, "score")


EXPIRED = "reservation string, expired_at timestamp"


def expiring(stream: DataFrame, reservation: str, op: str, ts: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(reservation, expired_at) of holds that were neither confirmed nor released within ``ttl_seconds`` of their reserve.

    One small state per open hold; event-time timers end it, so a replayed stream gives the same rows.
    """

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (end,) = state.get
            state.remove()
            yield pd.DataFrame({"reservation": [key[0]], "expired_at": [pd.Timestamp(end, unit="ms")]})
            return
        end = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for what, at in zip(rows["op"], rows["ts"], strict=True):
            now = int(at.timestamp() * 1000)
            if end is not None and now >= end:
                out.append(end)
                end = None
            if what == "reserve" and end is None:
                end = now + ttl_seconds * 1000
            elif what in ("confirm", "release"):
                end = None
        if end is None:
            if state.exists:
                state.remove()
        else:
            state.update((end,))
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"reservation": [key[0]] * len(out), "expired_at": [pd.Timestamp(e, unit="ms") for e in out]})

    rows = stream.select(F.col(reservation).cast("string").alias("reservation"), F.col(op).alias("op"), F.col(ts).alias("ts")).withWatermark("ts", late)
    return rows.groupBy("reservation").applyInPandasWithState(hold, EXPIRED, "end long", "append", "EventTimeTimeout")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all input there is now, as a written table; in complete mode the last batch's."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(path if mode == "complete" else f"{path}/batch=-1")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

"""Write policies and consistency between a cache and its database, from logs of writes, reads and flushes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def cache_aside(log: DataFrame, key: str, seq: str, at: str, is_write: str, ttl: int) -> DataFrame:
    """Reads of a log with ``hit``: a write deletes the key's entry, the next read misses and loads it for ``ttl``.

    Between two writes a history is a plain replay, so (key, writes so far) is the unit of parallel work. A read of the same
    ``seq`` as a write of its key comes after that write.
    """
    from .replay import ttl_replay

    upto = W.partitionBy(key).orderBy(F.asc_nulls_last(seq)).rangeBetween(W.unboundedPreceding, W.currentRow)
    era = log.withColumn("era", F.count_if(F.col(is_write)).over(upto)).where(~F.col(is_write))
    unit = F.struct(F.col(key).alias("key"), "era")
    return ttl_replay(era.withColumn("unit", unit), "unit", at, seq, ttl).select(F.col("unit.key").alias(key), at, seq, "hit")


def final_values(writes: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """What cache and database hold after write-through, and the cache after write-back: each key's last value."""
    return writes.groupBy(key).agg(F.max_by(value, seq).alias("value"))


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that one of two stores has and the other lacks; empty when they agree."""
    return one.exceptAll(other).unionByName(other.exceptAll(one))


def flushes(writes: DataFrame, key: str, seq: str, value: str, epoch: str) -> DataFrame:
    """Write-back: a flush writes each dirty key once, with its latest value: (epoch, key, value, coalesced writes)."""
    return writes.groupBy(epoch, key).agg(F.max_by(value, seq).alias("value"), (F.count(F.lit(1)) - 1).alias("saved"))


def lost(writes: DataFrame, seq: str, last_flush: int) -> DataFrame:
    """Writes after the last flush, which a crash takes."""
    return writes.where(F.col(seq) > last_flush)


def versioned(writes: DataFrame, key: str, seq: str, version: str) -> DataFrame:
    """writes with ``accepted``: a version is taken only if it is greater than all before it."""
    before = F.max(version).over(W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    return writes.withColumn("accepted", before.isNull() | (F.col(version) > before))


def stale_fills(fills: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """Fills (key, fill_id, read_at, filled_at) that put an old value into the cache: the key was written after the read and
    not after the fill."""
    w = writes.select(F.col(key), F.col("written_at"))
    after_read = (F.col("f.read_at") < F.col("w.written_at")) & (F.col("w.written_at") <= F.col("f.filled_at"))
    return fills.alias("f").join(w.alias("w"), (F.col(f"f.{key}") == F.col(f"w.{key}")) & after_read, "left_semi")


def staleness(fills: DataFrame, writes: DataFrame, key: str, delay: int, ttl: int) -> DataFrame:
    """How long a stale fill lives: until a second delete ``delay`` after the write, its expiry, or the next write."""
    none = F.lit(None).cast(writes.schema["written_at"].dataType)
    wrote = writes.select(key, F.col("written_at").alias("at"), F.col("written_at").alias("w"), F.lit(None).cast(fills.schema["fill_id"].dataType).alias("fill_id"), none.alias("filled_at"), F.lit(2).alias("kind"))
    moment = lambda kind, at: fills.select(key, F.col(at).alias("at"), none.alias("w"), "fill_id", "filled_at", F.lit(kind).alias("kind"))
    events = wrote.unionByName(moment(0, "read_at")).unionByName(moment(1, "filled_at"))
    # From late to early; a write of the same moment stands behind, so what was met last is the first write after. Nothing is paired.
    back = W.partitionBy(key).orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, 0)
    after = events.withColumn("after", F.last("w", ignorenulls=True).over(back)).where("kind < 2")
    met = after.groupBy(key, "fill_id", "filled_at").agg(F.min(F.when(F.col("kind") == 0, F.col("after"))).alias("write"), F.min(F.when(F.col("kind") == 1, F.col("after"))).alias("next"))
    until = F.least(F.greatest(F.col("write") + delay, F.col("filled_at")), F.col("filled_at") + ttl, F.coalesce("next", F.col("filled_at") + ttl))
    return met.where("write <= filled_at").select(key, "fill_id", (until - F.col("filled_at")).alias("stale_for"))

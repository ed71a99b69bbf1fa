"""Asking for keys that don't exist: Bloom filters, exact membership, remembered absences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import bloom_slots


def slots(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """The filter as rows: each set slot once. m bounds the rows."""
    return keys.select(F.explode(bloom_slots(F.col(key).cast("string"), m, k)).alias("slot")).distinct()


def might_contain(probes: DataFrame, key: str, filter_slots: DataFrame, m: int, k: int) -> DataFrame:
    """probes with ``maybe``: false is certain. The set slots, m at most, are broadcast as one array of bits (64 to a number)."""
    mask = F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))")
    words = filter_slots.groupBy(F.floor(F.col("slot") / 64).alias("w")).agg(F.bit_or(mask).alias("bits"))
    every = words.sparkSession.range((m + 63) // 64).withColumnRenamed("id", "w").join(words, "w", "left").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda x: x["bits"]).alias("bits"))
    asked = probes.withColumn("_slots", bloom_slots(F.col(key).cast("string"), m, k)).join(F.broadcast(every))
    hit = F.forall("_slots", lambda s: F.getbit(F.element_at("bits", (F.floor(s / 64) + 1).cast("int")), F.pmod(s, F.lit(64)).cast("int")) == 1)
    return asked.withColumn("maybe", hit).drop("_slots", "bits")


def fill_ratio(filter_slots: DataFrame, m: int) -> DataFrame:
    return filter_slots.agg((F.count(F.lit(1)) / F.lit(m)).alias("fill"))


def present(probes: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """probes with ``exists``, exactly."""
    return probes.join(existing.select(key).distinct().withColumn("exists", F.lit(True)), key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def absent(probes: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Requests that a plain cache passes to the database every time: those for keys that don't exist."""
    return probes.join(existing.select(key), key, "left_anti")


def false_positives(judged: DataFrame) -> DataFrame:
    """(requests, absent, false_positives, rate, false_negatives) of probes with ``maybe`` and ``exists``."""
    missing, wrong = F.count_if(~F.col("exists")), F.count_if(~F.col("exists") & F.col("maybe"))
    return judged.agg(F.count(F.lit(1)).alias("requests"), missing.alias("absent"), wrong.alias("false_positives"), F.coalesce(F.try_divide(wrong, missing), F.lit(0.0)).alias("rate"), F.count_if(F.col("exists") & ~F.col("maybe")).alias("false_negatives"))


def invisible(reads: DataFrame, creations: DataFrame, key: str, ts: str, created: str, ttl: int) -> DataFrame:
    """Rows created while a tombstone of theirs was live: (key, created, visible_at). A tombstone lives from a read of a
    missing key for ``ttl`` ticks, its end excluded; the latest live one decides."""
    events = reads.select(F.col(key), F.col(ts).alias("_at"), F.col(ts).alias("_tomb")).unionByName(creations.select(F.col(key), F.col(created).alias("_at"), F.lit(None).cast(reads.schema[ts].dataType).alias("_tomb")))
    # Tombstones stand before creations of the same moment; the last one before a creation decides, so nothing is paired.
    before = W.partitionBy(key).orderBy(F.col("_at"), F.col("_tomb").isNull()).rowsBetween(W.unboundedPreceding, 0)
    last = events.withColumn("_last", F.last("_tomb", ignorenulls=True).over(before)).where(F.col("_tomb").isNull() & (F.col("_at") < F.col("_last") + ttl))
    return last.groupBy(key, F.col("_at").alias(created)).agg((F.max("_last") + ttl).alias("visible_at"))

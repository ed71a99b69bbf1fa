"""Generated traces: the same rows on every run and for any number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import coin


def season(spark: SparkSession, events: int = 30_000, players: int = 10_000, skew: float = 2.5) -> DataFrame:
    """Score events (seq, player, region, points): a player is picked as u**skew, so low numbers play most."""
    seq = spark.range(events).withColumnRenamed("id", "seq")
    player = F.floor(F.pow(coin("player", F.col("seq")), F.lit(skew)) * players)
    return seq.select("seq", player.alias("player"), F.pmod(player, F.lit(3)).alias("region"), (F.lit(1) + F.floor(coin("points", F.col("seq")) * 50)).alias("points"))


def zipf(spark: SparkSession, accesses: int = 4_000, keys: int = 60, s: float = 1.0) -> DataFrame:
    """Accesses (seq, key) to k0, k1, ... with weights 1 / rank**s, by inverse distribution: a coin falls in one key's interval.

    The intervals, one row a key, are broadcast; ``keys`` bounds them.
    """
    weight = F.lit(1.0) / F.pow(F.col("id") + 1, F.lit(s))
    order = W.orderBy("id")
    cumulated = spark.range(keys).select("id", F.sum(weight).over(order).alias("upto"), F.sum(weight).over(W.partitionBy()).alias("whole"))
    bounds = cumulated.select("id", F.lag("upto", 1, 0.0).over(order).alias("lo"), F.col("upto").alias("hi"), "whole")
    ends = bounds.agg(F.sort_array(F.collect_list(F.struct(F.col("hi") / F.col("whole"), "id"))).alias("ends"))
    drawn = spark.range(accesses).select(F.col("id").alias("seq"), coin("zipf", F.col("id")).alias("u"))
    key = F.filter("ends", lambda e: e["col1"] > F.col("u"))[0]["id"]
    return drawn.join(F.broadcast(ends)).select("seq", F.concat(F.lit("k"), F.coalesce(key, F.lit(keys - 1))).alias("key"))


def scan(spark: SparkSession, hot: int = 8, warm_rounds: int = 40, cold: int = 300, burst: int = 16) -> DataFrame:
    """(seq, phase, key): rounds of hot keys to warm up, then a scan of cold keys in bursts, a hot round after each."""
    warm = spark.range(warm_rounds * hot).select(F.col("id").alias("seq"), F.lit("warm").alias("phase"), F.concat(F.lit("h"), F.pmod("id", F.lit(hot))).alias("key"))
    bursts, head = -(-cold // burst), warm_rounds * hot
    keys = spark.range(cold).select((head + F.col("id") + F.floor(F.col("id") / burst) * hot).alias("seq"), F.lit("measure").alias("phase"), F.concat(F.lit("s"), "id").alias("key"))
    step = F.floor(F.col("id") / hot)
    rounds = spark.range(bursts * hot).select((head + F.least((step + 1) * burst, F.lit(cold)) + F.col("id")).alias("seq"), F.lit("measure").alias("phase"), F.concat(F.lit("h"), F.pmod("id", F.lit(hot))).alias("key"))
    return warm.unionByName(keys).unionByName(rounds)

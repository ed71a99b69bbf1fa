"""Skewed traffic: who is hot, where it lands, and ways to spread it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import coin, fnv1a, shard_of
from .policies import SEEDS


def key_counts(traffic: DataFrame, key: str) -> DataFrame:
    return traffic.groupBy(key).agg(F.count(F.lit(1)).alias("requests"))


def heavy_hitters(traffic: DataFrame, key: str, k: int) -> DataFrame:
    """The k most requested keys, exactly; ties by key."""
    return key_counts(traffic, key).orderBy(F.desc("requests"), key).limit(k)


def heavy_hitters_approx(traffic: DataFrame, key: str, k: int, tracked: int = 10_000) -> DataFrame:
    """The same from a sketch of bounded size: one pass without a shuffle by key; counts may be too high."""
    return traffic.agg(F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("top")).select(F.inline("top")).withColumnsRenamed({"item": key, "count": "requests"})


def shard_load(traffic: DataFrame, key: str, shards: int) -> DataFrame:
    """(shard, requests, hottest): keys are counted first, so each distinct key is hashed once."""
    loads = key_counts(traffic, key).groupBy(shard_of(F.col(key).cast("string"), shards).alias("shard")).agg(F.sum("requests").alias("requests"))
    first = F.row_number().over(W.orderBy(F.desc("requests"), "shard"))
    return loads.withColumn("hottest", first == 1)


def traffic_share(loads: DataFrame, shards: int) -> DataFrame:
    """Each shard's share of all requests, and how many times its fair share that is."""
    share = F.col("requests") / F.sum("requests").over(W.partitionBy())
    return loads.select("shard", "requests", share.alias("share"), (share * shards).alias("times_fair"))


def near_cache_loads(traffic: DataFrame, key: str, server: Column) -> DataFrame:
    """With a local cache on each server only the first read of a key on a server goes on: (requests, loads) per key."""
    by_server = traffic.select(key, server.alias("_server")).groupBy(key, "_server").agg(F.count(F.lit(1)).alias("n"))
    return by_server.groupBy(key).agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("loads"))


def near_cache_ttl(traffic: DataFrame, key: str, server: Column, at: str, order: str, ttl: int) -> DataFrame:
    """The same where a local entry lives ``ttl`` from its load: (requests, loads) per key; each server's copy is replayed alone."""
    from .replay import ttl_replay

    copies = traffic.select(F.struct(F.col(key).alias("key"), server.alias("server")).alias("copy"), at, order)
    replayed = ttl_replay(copies, "copy", at, order, ttl)
    return replayed.groupBy(F.col("copy.key").alias(key)).agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("hit")).alias("loads"))


def replica_spread(traffic: DataFrame, key: str, seq: str, replicas: int, shards: int) -> DataFrame:
    """Load per shard when each read goes to a random one of ``replicas`` copies named key#r."""
    copy = F.concat_ws("#", F.col(key).cast("string"), F.floor(coin("replica", F.col(seq)) * replicas).cast("string"))
    return shard_load(traffic.select(copy.alias("_copy")), "_copy", shards)


def sharded_counter(increments: DataFrame, key: str, by: Column, seq: str, ways: int) -> DataFrame:
    """Sums per key in two steps, first by key and a random part of it, then by key: no task adds up all of a hot key."""
    salted = increments.select(key, by.alias("_by"), F.floor(coin("counter", F.col(seq)) * ways).alias("_part"))
    return salted.groupBy(key, "_part").agg(F.sum("_by").alias("_sum")).groupBy(key).agg(F.sum("_sum").alias("total"), F.count(F.lit(1)).alias("parts"))


def since(traffic: DataFrame, ts: str, reset: Column) -> DataFrame:
    """Traffic after counters were reset: data stay, only what is counted changes."""
    return traffic.where(F.col(ts) >= reset)


def _cells(key: str, width: int) -> Column:
    """The cells (row, slot) of a key, one for each seed."""
    text = F.col(key).cast("string")
    return F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(fnv1a(text, seed), F.lit(width)).alias("slot")) for r, seed in enumerate(SEEDS)])


def sketch(traffic: DataFrame, key: str, width: int) -> DataFrame:
    """Count-min sketch as rows (row, slot, n): keys are counted first, so each distinct key is hashed once; width bounds the rows."""
    return key_counts(traffic, key).select("requests", F.inline(_cells(key, width))).groupBy("row", "slot").agg(F.sum("requests").alias("n"))


def estimates(keys: DataFrame, key: str, cells: DataFrame, width: int) -> DataFrame:
    """(key, estimate): the least of a key's cells, never below its count. The sketch, len(SEEDS) * width rows, is broadcast."""
    asked = keys.select(key).distinct().select(key, F.inline(_cells(key, width)))
    return asked.join(F.broadcast(cells), ["row", "slot"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0).cast("bigint"))).alias("estimate"))


def count_min(traffic: DataFrame, key: str, eps: float, confidence: float, seed: int = 7) -> DataFrame:
    """One row with a binary ``sketch`` of an integer key's counts, made of partial sketches that merge; eps and confidence bound its size."""
    return traffic.agg(F.count_min_sketch(F.col(key).cast("bigint"), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def _counters(made: DataFrame) -> DataFrame:
    """The counters of count_min()'s sketch as rows (row, slot, n); of each row also its ``factor`` and ``width``.

    The sketch holds a version and its total, 12 bytes, then depth and width (4 bytes each), a factor for each row, then the rows'
    counters (8 bytes each).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in (x for batch in batches for x in batch.column(0).to_pylist()):
            depth, width = np.frombuffer(raw, ">i4", 2, 12).tolist()
            factors = np.frombuffer(raw, ">i8", depth, 20).astype(np.int64)
            n = np.frombuffer(raw, ">i8", depth * width, 20 + 8 * depth).astype(np.int64)
            row, slot = np.divmod(np.arange(depth * width, dtype=np.int64), width)
            yield pa.RecordBatch.from_pydict({"row": row, "slot": slot, "n": n, "factor": factors[row], "width": np.full(len(n), width, np.int64)})

    return made.select("sketch").mapInArrow(read, "row bigint, slot bigint, n bigint, factor bigint, width bigint")


def _count_min_cells(keys: DataFrame, key: str, counters: DataFrame) -> DataFrame:
    """(key, row, slot): each distinct key's cells in all rows of the sketch. A null has none."""
    rows = counters.where(F.col("slot") == 0).agg(F.collect_list(F.struct("row", "factor", "width")).alias("_rows"))
    low = F.lit(0xFFFFFFFF)

    def cell(r: Column) -> Column:
        part = r["factor"] * F.col("_key").bitwiseAND(low)  # factor < 2**31, so nothing is lost
        high = F.shiftright(part, 32) + r["factor"] * F.shiftright("_key", 32)
        return F.struct(r["row"].alias("row"), F.pmod((part.bitwiseAND(low) + high.bitwiseAND(low)).bitwiseAND(F.lit(0x7FFFFFFF)), r["width"]).alias("slot"))

    asked = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_key", F.col(key).cast("bigint"))
    return asked.join(F.broadcast(rows)).select(key, F.inline(F.transform("_rows", cell)))


def count_min_estimates(keys: DataFrame, key: str, made: DataFrame) -> DataFrame:
    """(key, estimate) from count_min(): with its confidence at most eps times all requests too high, never too low.

    The sketch's counters, of bounded number, are broadcast as rows.
    """
    counters = _counters(made)
    found = _count_min_cells(keys, key, counters).join(F.broadcast(counters.select("row", "slot", "n")), ["row", "slot"])
    return found.groupBy(key).agg(F.min("n").alias("estimate"))


def count_min_settled(traffic: DataFrame, key: str, made: DataFrame) -> DataFrame:
    """(key, estimate) for traffic's own keys from count_min(), with an exact check behind it: no estimate is too high.

    A key that has a counter to itself has its count there. Such keys are no more than counters, so they are broadcast; a key that
    shares all its counters with others (most do when keys outnumber counters), or is null, is counted from the traffic.
    """
    counters = _counters(made)
    alone = _count_min_cells(traffic, key, counters).groupBy("row", "slot").agg(F.count(F.lit(1)).alias("_keys"), F.min(key).alias(key)).where(F.col("_keys") == 1)
    sure = counters.join(F.broadcast(alone.select("row", "slot", key)), ["row", "slot"]).groupBy(key).agg(F.min("n").alias("estimate"))
    shared = traffic.select(key).join(F.broadcast(sure.select(key)), key, "left_anti")
    return sure.unionByName(shared.groupBy(key).agg(F.count(F.lit(1)).alias("estimate")))

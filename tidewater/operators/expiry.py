"""Expiry without stampedes: jitter, stale-while-revalidate, early recomputation by chance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import coin


def naive_loads(requests: DataFrame, key: str, at: str, load_time: int) -> DataFrame:
    """(key, burst, loads): without a shared flight every request until the first load of a burst is done loads itself.

    A burst starts when no load is in flight; requests that follow within ``load_time`` of its start belong to it.
    """
    from .replay import ttl_replay

    led = ttl_replay(requests, key, at, "seq", load_time)
    each = W.partitionBy(key).orderBy(at, "seq").rowsBetween(W.unboundedPreceding, 0)
    return led.withColumn("burst", F.count_if(~F.col("hit")).over(each)).groupBy(key, "burst").agg(F.count(F.lit(1)).alias("loads"))


def jittered(base: int, spread: int, *keys: Column) -> Column:
    return F.lit(base) + F.floor(coin("jitter", *keys) * spread)


def expiry_peak(keys: DataFrame, expires: Column) -> DataFrame:
    """The most entries that expire in one second, and the seconds in which any do."""
    per = keys.select(F.floor(expires / 1000).alias("second")).groupBy("second").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("n").alias("peak"), F.count(F.lit(1)).alias("seconds"))


def stale_while_revalidate(requests: DataFrame, key: str, at: str, order: str, load_time: int, fresh_for: int) -> DataFrame:
    """requests with ``stale`` and ``refresh``. Past its soft end (strictly) a value is still served, and the first such
    request starts the one refresh; when that is done the value is fresh for ``fresh_for``. The first request of a key finds it stale.

    A key's cycle is fixed by its refreshes: one at time t covers all up to t + load_time + fresh_for, which is a read-through
    life of that length.
    """
    from .replay import ttl_replay

    replayed = ttl_replay(requests, key, at, order, load_time + fresh_for)
    each = W.partitionBy(key).orderBy(at, order).rowsBetween(W.unboundedPreceding, 0)
    began = F.last(F.when(~F.col("hit"), F.col(at)), ignorenulls=True).over(each)
    return replayed.withColumn("refresh", ~F.col("hit")).withColumn("stale", ~F.col("hit") | (F.col(at) < began + load_time)).drop("hit")


def hard_herd(readers: DataFrame, tick: str, ttl: int) -> DataFrame:
    """(tick, recomputes): when an entry ends (inclusive) all readers of that tick recompute it, and it lives on for ``ttl``."""
    return readers.where((F.col(tick) > 0) & (F.col(tick) % ttl == 0)).groupBy(tick).agg(F.count(F.lit(1)).alias("recomputes"))


def early_probability(left: Column, delta: float, beta: Column) -> Column:
    """The chance that a reader recomputes with ``left`` to go: exp(-left / (delta * beta)), 1 at the end and after."""
    return F.least(F.lit(1.0), F.exp(-left / (F.lit(delta) * beta)))


def early_refreshes(readers: DataFrame, tick: str, reader: str, ttl: int, delta: float, betas: list[float]) -> DataFrame:
    """(beta, tick, reader) of each refresh: the first reader in order for whom now - delta * beta * ln(u) has reached the
    end recomputes, and the end moves to now + ttl.

    How far a reader reaches depends on its own coin alone. Of a tick's readers only these can matter: who reaches beyond
    tick + ttl, which is the furthest that an end can be, and before them who reaches further than all others so far.
    The chain of refreshes is a fold over these few, of which the end alone is held.
    """
    u = F.lit(1.0) - coin("xfetch", F.col(tick), F.col(reader))
    every = readers.select(tick, reader, F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"), u.alias("u"))
    reach = F.col(tick) - F.lit(delta) * F.col("beta") * F.ln("u")
    before = F.max("reach").over(W.partitionBy("beta", tick).orderBy(reader).rowsBetween(W.unboundedPreceding, -1))
    leads = every.withColumn("reach", reach).withColumn("best", before).where(F.col("best").isNull() | (F.col("reach") > F.col("best")) | (F.col("reach") >= F.col(tick) + ttl))
    rows = leads.select("beta", F.col(tick).cast("bigint").alias("tick"), F.col(reader).cast("bigint").alias("reader"), "reach")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, end = None, ttl
        for f in frames:
            fired = []
            for b, t, far in zip(f["beta"], f["tick"], f["reach"], strict=True):
                if b != at:
                    at, end = b, ttl
                fired.append(far >= end)
                end = t + ttl if fired[-1] else end
            yield f.loc[fired, ["beta", "tick", "reader"]]

    return rows.repartition("beta").sortWithinPartitions("beta", "tick", "reader").mapInPandas(run, "beta double, tick bigint, reader bigint")

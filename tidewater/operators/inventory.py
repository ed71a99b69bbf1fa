"""Selling what there is: conditional decrements, reservations with a time limit, and the identity that must hold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def oversold(requests: DataFrame, item: str, stock: int) -> DataFrame:
    """Read, check, write without a guard: all who ask at once see the same stock. (item, orders, oversold, final_stock)."""
    n = F.count(F.lit(1))
    return requests.groupBy(item).agg(n.alias("orders"), F.greatest(n - stock, F.lit(0).cast("bigint")).alias("oversold"), F.lit(stock - 1).cast("bigint").alias("final_stock"))


def gate(requests: DataFrame, item: str, seq: str, stock: Column) -> DataFrame:
    """requests with ``won``: the first ``stock`` of each item. Spark keeps no more than it must of an item's losers only if
    the caller filters on a constant; here all come back, each item's in one sorted run."""
    return requests.withColumn("won", F.row_number().over(W.partitionBy(item).orderBy(seq)) <= stock)


def winners(requests: DataFrame, item: str, seq: str, stock: int) -> DataFrame:
    """The first ``stock`` of each item alone: partial limits on every task come before the shuffle."""
    return requests.withColumn("place", F.row_number().over(W.partitionBy(item).orderBy(seq))).where(F.col("place") <= stock)


def outcomes(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count_if("won").alias("winners"), F.count_if(~F.col("won")).alias("bounced"))


def gate_outcomes(requests: DataFrame, item: str, stock: Column) -> DataFrame:
    """outcomes() of gate(), by counts alone: nothing is ordered. ``stock`` may be a column that is the same in all rows of an item."""
    per = requests.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.first(stock).cast("bigint").alias("stock"))
    won = F.least("n", F.greatest("stock", F.lit(0).cast("bigint")))
    return per.agg(F.sum(won).alias("winners"), F.sum(F.col("n") - won).alias("bounced"))


def greedy(requests: DataFrame, item: str, seq: str, qty: str, stock: float) -> DataFrame:
    """requests (item, seq, qty) with ``won``: each takes its quantity if there is still enough; who asks for too much is
    skipped, and later smaller ones may still fit. An ordered stream per item, of which only the stock left is held."""
    rows = requests.select(F.col(item).alias("item"), F.col(seq).cast("bigint").alias("seq"), F.col(qty).cast("double").alias("qty")).repartition("item").sortWithinPartitions("item", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left = None, stock
        for f in frames:
            won = []
            for i, q in zip(f["item"], f["qty"], strict=True):
                if i != at:
                    at, left = i, stock
                won.append(q <= left)
                left -= q if won[-1] else 0
            yield f.assign(won=won)

    kind = requests.schema[item].dataType.simpleString()
    return rows.mapInPandas(run, f"item {kind}, seq bigint, qty double, won boolean").withColumnsRenamed({"item": item, "seq": seq, "qty": qty})


def queued(requests: DataFrame, item: str, seq: str, tokens: int) -> DataFrame:
    """requests with ``turn`` and ``token``: each item has one writer, which takes its requests in order, from turn 1 on, and hands out tokens
    1 to ``tokens``; who comes after them gets none (null). An item's queue is one sorted run, of which a counter is held."""
    turn = F.row_number().over(W.partitionBy(item).orderBy(seq)).cast("bigint")
    return requests.withColumn("turn", turn).withColumn("token", F.when(F.col("turn") <= tokens, F.col("turn")))


LEDGER = "available bigint, live bigint, confirmed bigint"


def ledger(log: DataFrame, item: str, seq: str, tick: str, op: str, reservation: str, stock: int, ttl: int) -> DataFrame:
    """The ledger after each operation: (item, seq, ok, available, live, confirmed).

    reserve takes one if there is one and holds it until tick + ttl; confirm works on a live hold before its end; release
    gives a live hold back, once; sweep gives all live holds back that have reached their end. One ordered stream per
    item; live holds are held, no more than the stock.
    """
    rows = log.select(F.col(item).alias("item"), F.col(seq).cast("bigint").alias("seq"), F.col(tick).cast("bigint").alias("tick"), F.col(op).alias("op"), F.col(reservation).cast("string").alias("id")).repartition("item").sortWithinPartitions("item", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, available, holds, confirmed = None, stock, {}, 0
        for f in frames:
            out = []
            for i, s, now, what, r in zip(f["item"], f["seq"], f["tick"], f["op"], f["id"], strict=True):
                if i != at:
                    at, available, holds, confirmed = i, stock, {}, 0
                ok = False
                if what == "reserve" and available > 0 and r not in holds:
                    holds[r], available, ok = now + ttl, available - 1, True
                elif what == "confirm" and now < holds.get(r, now):
                    del holds[r]
                    confirmed, ok = confirmed + 1, True
                elif what == "release" and r in holds:
                    del holds[r]
                    available, ok = available + 1, True
                elif what == "sweep":
                    ended = [k for k, end in holds.items() if now >= end]
                    for k in ended:
                        del holds[k]
                    available, ok = available + len(ended), bool(ended)
                out.append((i, s, ok, available, len(holds), confirmed))
            yield pd.DataFrame(out, columns=["item", "seq", "ok", "available", "live", "confirmed"])

    kind = log.schema[item].dataType.simpleString()
    return rows.mapInPandas(run, f"item {kind}, seq bigint, ok boolean, {LEDGER}").withColumnsRenamed({"item": item, "seq": seq})


def identity(ledger_: DataFrame, stock: int) -> DataFrame:
    """ledger with ``balanced``: what was there is confirmed, held or available."""
    return ledger_.withColumn("balanced", F.col("available") + F.col("live") + F.col("confirmed") == stock)

"""Mixing sources to target weights by the cube method.

Each source gets a share of all words by its weight. A document of a source is then expected
target / size times in the mix: the whole part is certain, the fraction is an inclusion probability.
The flight moves three probabilities at a time along the direction that changes neither the number of
documents nor that of words, until one of them is 0 or 1; at the end two units at most are undecided.
Blocks of a source fly on their own, what they leave flies in larger blocks, and so on, until each
source has one block and lands: the last two are decided by coin, the first of them keeping the count, and then those
decisions of the block are turned round, one at a time, that bring its words nearest to what was due.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .columns import fresh, of, quoted, row_key
from .store import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 1024


def flight(pi: list[float], count: Sequence[float], size: Sequence[float], coin: random.Random, land: bool = False) -> list[float]:
    """Probabilities after the flight: all but two at most are 0 or 1, and the sums of pi*count and pi*size are as before.

    land: then the rest is decided too, first keeping the count, then by coin.
    """

    def move(at: list[int], u: list[float]) -> None:
        up = min((1 - pi[k]) / x if x > 0 else pi[k] / -x for k, x in zip(at, u, strict=True) if x)
        down = min(pi[k] / x if x > 0 else (1 - pi[k]) / -x for k, x in zip(at, u, strict=True) if x)
        step = up if coin.random() * (up + down) < down else -down
        for k, x in zip(at, u, strict=True):
            p = pi[k] + step * x
            pi[k] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p

    active: list[int] = []
    for k in range(len(pi)):
        if not 0 < pi[k] < 1:
            continue
        active.append(k)
        if len(active) == 3:
            a, b, c = active
            u = [count[b] * size[c] - count[c] * size[b], count[c] * size[a] - count[a] * size[c], count[a] * size[b] - count[b] * size[a]]
            move(active, u if any(u) else [count[b], -count[a], 0.0])
            active = [j for j in active if 0 < pi[j] < 1]
    if land:
        if len(active) == 2:
            move(active, [count[active[1]], -count[active[0]]])
            active = [j for j in active if 0 < pi[j] < 1]
        for k in active:
            pi[k] = float(coin.random() < pi[k])
    return pi


def turned(pi: list[float], due: Sequence[float], size: Sequence[float]) -> list[float]:
    """Decisions after the landing: while it brings sum(pi*size) nearer to sum(due*size), the best one is turned round."""
    over = sum((p - d) * s for p, d, s in zip(pi, due, size, strict=True))
    open_ = [k for k, d in enumerate(due) if 0 < d < 1]
    while open_:
        k = min(open_, key=lambda k: abs(over + (1 - 2 * pi[k]) * size[k]))
        better = over + (1 - 2 * pi[k]) * size[k]
        if abs(better) >= abs(over):
            break
        over, pi[k] = better, 1 - pi[k]
    return pi


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, size, units) with ``target``: shares of all sizes by weight, at most ``most`` times the source's size.

    Sources take the weights in turn, in code point order, null last. Filling level: with sources by rising most * size /
    weight, those below the level are full and the others share what is left. One row a source; two small windows.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    cap = F.col("size") * F.lit(float(most))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    level = (F.sum("size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    filled = weighed.withColumn("cap", cap).withColumn("full_at", cap / F.col("weight")).withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(W.partitionBy())
    return filled.withColumn("final", first["level"]).select("source", "size", "units", F.least("cap", F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = 3, seed: int = 0, out: str = "mix") -> DataFrame:
    """df with a struct column ``out``: size (words), source_size, target, copies (how often the mix takes the row).

    Reruns agree: all coins come from hashes of ids, texts and ``seed``. Null source is a source of its own, the last.
    Null text has size 0; such rows are taken about as often as their source's others. Rows alike in id, text and
    source are one unit and are taken alike. A source without words has target 0 and copies 0. An empty table
    gives an empty one. A column of df called ``out`` is replaced.

    A source's rows go in blocks of about BLOCK units, so one that holds most rows is spread over many tasks; only
    (key, size, probability) is shuffled for that, never the text.
    """
    sized = df.select(row_key(id_column, text).alias("key"), quoted(source).cast("string").alias("source"), _words(quoted(text)).alias("size"))
    units = stored(sized.groupBy("key", "source").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count(F.lit(1)).alias("units"))
    plan = stored(targets(totals, weights, most), "mix-targets")
    largest = plan.agg(F.coalesce(F.max("units"), F.lit(0)).alias("n")).first()["n"]
    want = F.when(F.col("s.size") > 0, F.col("target") / F.col("s.size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(want - F.round(want)) < 1e-9, F.round(want)).otherwise(want)
    joined = units.alias("u").join(plan.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
    state = joined.select("key", F.col("u.source").alias("source"), F.col("u.size").alias("size"), "n", "units", F.col("s.size").alias("source_size"), "target", F.floor(near).cast("int").alias("sure"), (near - F.floor(near)).alias("pi"))
    decided, blocks = None, max(1, -(-largest // BLOCK))
    schema = state.schema
    span = BLOCK
    while True:
        last = blocks == 1
        block = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(span)), F.greatest(F.lit(1), F.ceil(F.col("units") / F.lit(span))))
        flown = stored(state.groupBy("source", block.alias("block")).applyInPandas(_fly(seed, span, last, list(schema.names)), schema), "mix-flight")
        whole = flown.where("pi = 0 or pi = 1")
        decided = whole if decided is None else decided.unionByName(whole)
        if last:
            break
        state, span = flown.where("pi > 0 and pi < 1"), span * (BLOCK // 2)
        blocks = max(1, -(-largest // span))
    i, t, k = fresh(df, "_i"), fresh(df, "_t"), fresh(df, "_source")
    picked = decided.select(F.col("key.i").alias(i), F.col("key.t").alias(t), F.col("source").alias(k), F.struct("size", "source_size", "target", (F.col("sure") + F.col("pi").cast("int")).alias("copies")).alias(out))
    had = [c for c in df.columns if c.lower() != out.lower()]
    keyed = df.select(*[quoted(c) for c in had], row_key(id_column, text)["i"].alias(i), row_key(id_column, text)["t"].alias(t))
    same = (F.col(f"d.{i}") == F.col(f"p.{i}")) & (F.col(f"d.{t}") == F.col(f"p.{t}")) & of("d", source).cast("string").eqNullSafe(F.col(f"p.{k}"))
    return keyed.alias("d").join(picked.alias("p"), same).select(*[of("d", c).alias(c) for c in had], of("p", out).alias(out))


def _fly(seed: int, span: int, land: bool, names: list[str]):
    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group[names]
        keys = [(k["i"], k["t"]) for k in group["key"]]
        order = sorted(range(len(group)), key=lambda j: (random.Random(f"{seed}/{span}/{keys[j]}").random(), keys[j]))
        group = group.iloc[order]
        n = group["n"].astype(float).tolist()
        words = (group["size"] * group["n"]).astype(float).tolist()
        name = group["source"].iloc[0]
        coin = random.Random(f"{seed}/{span}/{name!r}/{keys[order[0]]}")
        due = group["pi"].tolist()
        pi = flight(list(due), n, words, coin, land)
        return group.assign(pi=turned(pi, due, words) if land else pi)

    return fly


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of df, each as often as mix() takes it; columns as they were."""
    name = fresh(df, "_mix")
    taken = mix(df, out=name, **options)
    again = F.explode(F.array_repeat(F.lit(1), F.col(name)["copies"]))
    return taken.select(*[quoted(c) for c in df.columns], again.alias(fresh(taken, "_again"))).select(*[quoted(c) for c in df.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = F.col("mix")
    return mix(docs).select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"))

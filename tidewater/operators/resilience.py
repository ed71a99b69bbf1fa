"""When the cache is down: goodput, limiting, circuit breaking, avalanche and recovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def goodput(n: Column, capacity: int, healthy: Column | None = None) -> Column:
    """Queries done in time when n come at once: all up to the capacity; beyond it each one more costs one; none when unhealthy."""
    served = F.when(n <= capacity, n).otherwise(F.greatest(F.lit(0).cast("bigint"), F.lit(2 * capacity) - n))
    return served if healthy is None else F.when(healthy, served).otherwise(F.lit(0).cast("bigint"))


def peak_in_flight(calls: DataFrame, start: str, end: str, by: str) -> DataFrame:
    """The most calls under way at once, for each ``by``; a call that ends when another starts is over."""
    edges = calls.select(by, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(calls.select(by, F.col(end).alias("t"), F.lit(-1).alias("d")))
    moments = edges.groupBy(by, "t").agg(F.sum("d").alias("d"))
    running = F.sum("d").over(W.partitionBy(by).orderBy("t"))
    return moments.withColumn("open", running).groupBy(by).agg(F.max("open").alias("peak"))


def admitted(requests: DataFrame, round_: str, seq: str, capacity: int) -> DataFrame:
    """requests with ``admitted``: the first ``capacity`` of a round; the others fail at once, none waits."""
    place = F.row_number().over(W.partitionBy(round_).orderBy(seq))
    return requests.withColumn("admitted", place <= capacity)


def breaker(rounds: DataFrame, key: str, round_: str, failed: Column, threshold: int, cooldown: int) -> DataFrame:
    """(key, round, state, allowed) of a circuit breaker for each key.

    Closed, it opens at ``threshold`` failed rounds in a row; open, it lets nothing through until ``cooldown`` rounds have
    passed, then tries (half-open): success closes it, failure opens it again. ``state`` is what a round met.
    Each key's rounds are one ordered stream, of which only the breaker's state is held.
    """
    rows = rounds.select(F.col(key).alias("key"), F.col(round_).cast("bigint").alias("round"), failed.alias("failed"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, failures, opened = None, "closed", 0, -1
        for f in frames:
            met = []
            for k, r, bad in zip(f["key"], f["round"], f["failed"], strict=True):
                if k != at:
                    at, state, failures, opened = k, "closed", 0, -1
                if state == "open" and r - opened >= cooldown:
                    state = "half-open"
                met.append(state)
                if state == "open":
                    continue
                failures = failures + 1 if bad else 0
                if bad and (state == "half-open" or failures >= threshold):
                    state, opened = "open", r
                elif not bad:
                    state = "closed"
            yield pd.DataFrame({"key": f["key"], "round": f["round"], "state": met, "allowed": [m != "open" for m in met]})

    kind = rounds.schema[key].dataType.simpleString()
    ordered = rows.repartition("key").sortWithinPartitions("key", "round")
    return ordered.mapInPandas(run, f"key {kind}, round bigint, state string, allowed boolean").withColumnRenamed("key", key)


AVALANCHE = "mode string, round bigint, hits bigint, db_load bigint, goodput bigint, shed bigint, success double, cached bigint"


def avalanche(requests: DataFrame, round_: str, seq: str, key: str, capacity: int, modes: list[str]) -> DataFrame:
    """A cold cache under load, round by round: naive, all misses go to the database; limited, ``capacity`` of them do.

    What a round served warms the cache for the next, so a mode is one ordered stream; its task holds the warm keys, which is
    what the cache itself holds, and one round's counts. Modes run in parallel.
    """
    kind = requests.schema[key].dataType.simpleString()
    each = requests.select(F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"), F.col(round_).cast("bigint").alias("round"), F.col(seq).alias("seq"), F.col(key).cast(kind).alias("key"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, warm, sent, asked, missed = None, set(), [], 0, 0

        def result() -> pd.DataFrame:
            """The round that ends: what it was served stays warm."""
            rows = []
            if at is not None:
                load = len(sent) if at[0] != "naive" else missed
                good = load if load <= capacity else max(0, 2 * capacity - load)
                warm.update(sent[:good])
                rows.append((*at, asked - missed, load, good, missed - load, (asked - missed + good) / asked, len(warm)))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in AVALANCHE.split(", ")])

        for f in frames:
            for mode, r, k in zip(f["mode"], f["round"], f["key"], strict=True):
                if (mode, r) != at:
                    yield result()
                    if at is None or mode != at[0]:
                        warm = set()
                    at, sent, asked, missed = (mode, r), [], 0, 0
                asked += 1
                if k not in warm:
                    missed += 1
                    if len(sent) < capacity:  # no more than the capacity is served in time, in any mode
                        sent.append(k)
        yield result()

    return each.repartition("mode").sortWithinPartitions("mode", "round", "seq").mapInPandas(run, AVALANCHE)


def recovery(rounds: DataFrame, success: float = 0.95) -> DataFrame:
    """For each mode the first round with that success; null if none."""
    return rounds.groupBy("mode").agg(F.min(F.when(F.col("success") >= success, F.col("round"))).alias("recovered"))

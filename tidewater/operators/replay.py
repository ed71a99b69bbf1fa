"""Cache replay over access traces: time-to-live folds and exact LRU distances.

A trace's outcomes depend on earlier outcomes ("since the last load"), which no window function can say. The
time-to-live fold runs over sorted Arrow batches with constant state; explicit operations and LRU lists are cut where the
state is known anyway, and the pieces replay in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def _lives(batches: Iterator[pa.RecordBatch], inclusive: bool) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (key, at, ord), unknown moments last in a key, with ``hit`` in place of ``first`` and ``ttl``. Between batches
    only the end of the entry that lives is held; a load jumps to the first access beyond its end."""
    side = "left" if inclusive else "right"
    most = np.iinfo(np.int64).max
    end: int | None = None
    for batch in batches:
        column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
        at, known = column("at").fill_null(0).to_numpy(), column("at").is_valid().to_numpy(zero_copy_only=False)
        lives = column("ttl").to_pylist()
        first = np.flatnonzero(column("first").to_numpy(zero_copy_only=False))
        hit, told = np.ones(len(at), bool), known.copy()
        cuts = sorted({0, *first.tolist()})
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
            if lo or (len(first) and first[0] == 0):
                end = None
                if lo < hi and not known[lo]:
                    hit[lo], told[lo] = False, True
            hi = lo + int(known[lo:hi].sum())
            place = lo if end is None else lo + int(np.searchsorted(at[lo:hi], end, side))
            while place < hi:
                hit[place] = False
                end = most if lives[place] is None else min(most, int(at[place]) + lives[place])
                # A life of no length may end before the next access at the same moment.
                place += 1 + int(np.searchsorted(at[place + 1 : hi], end, side)) if end < most else hi
        kept = [c for c in batch.schema.names if c not in ("first", "ttl")]
        yield pa.RecordBatch.from_arrays([*[column(c) for c in kept], pa.array(hit, mask=~told)], names=[*kept, "hit"])


def ttl_replay(trace: DataFrame, key: str, at: str, order: str, ttl: Column | int | None, inclusive: bool = False) -> DataFrame:
    """Read-through replay: trace's (key, at, order) with ``hit``. A miss loads; an entry lives ``ttl`` from its load, not
    from its last use; a ttl of null never ends. ``at`` is a BIGINT; ``order`` makes the order total; of accesses alike in both that
    with the shortest life comes first. Where ``at`` is null ``hit`` is null, but for a miss where a key has no other moments.

    Keys are sorted through by their tasks as a stream: one end of life is held, however long a key's history is.
    """
    life = F.lit(ttl).cast("bigint") if not isinstance(ttl, Column) else ttl.cast("bigint")
    seen = trace.select(key, F.col(at).cast("bigint").alias("at"), F.col(order).alias("ord"), life.alias("ttl"))
    turn = [F.asc_nulls_last(c) for c in ("at", "ord", "ttl")]
    first = F.row_number().over(W.partitionBy(key).orderBy(*turn)) == 1
    rows = seen.withColumn("first", first).sortWithinPartitions(key, *turn)
    kinds = T.StructType([*[rows.schema[c] for c in (key, "at", "ord")], T.StructField("hit", T.BooleanType())])
    return rows.mapInArrow(lambda batches: _lives(batches, inclusive), kinds).select(key, F.col("at").alias(at), F.col("ord").alias(order), "hit")


def op_replay(trace: DataFrame, key: str, at: str, order: str, op: str, ttl: int) -> DataFrame:
    """Replay of explicit operations: get and has count a hit or a miss, set (re)starts the life, delete ends it silently.

    A history is cut at every set and delete, after which the state is known; reads never change it, so a window does.
    """
    each = W.partitionBy(key).orderBy(at, order).rowsBetween(W.unboundedPreceding, -1)
    change = F.last(F.when(F.col(op).isin("set", "delete"), F.struct(F.col(op).alias("op"), F.col(at).alias("at"))), ignorenulls=True).over(each)
    live = (change["op"] == "set") & (F.col(at) <= change["at"] + ttl)
    return trace.withColumn("hit", F.when(F.col(op).isin("get", "has"), F.coalesce(live, F.lit(False))))


def stats(replayed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(hits, misses, hit_rate); the rate of nothing is 0."""
    hits, all_ = F.count_if("hit"), F.count("hit")
    return replayed.groupBy(*(by or [])).agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.try_divide(hits, all_), F.lit(0.0)).alias("hit_rate"))


def _latest(lists: Iterable[list[str]], most: int) -> list[str]:
    """The last ``most`` keys, the latest first, of lists like that of which each is later than those before."""
    state: list[str] = []
    for fresh in lists:
        known = set(fresh)
        state = (list(fresh) + [k for k in state if k not in known])[:most]
    return state


def _starts(lists: DataFrame, most: int, wide: int, levels: int) -> DataFrame:
    """(chunk, state): of lists (chunk, keys), the last ``most`` keys before each chunk.

    Taking the last keys is associative, so chunks are summed up by ``wide`` of them, their sums again, ``levels`` times, and a
    chunk starts from the sum of what lies before its group, then of what lies before it in the group. A task reads ``wide`` lists.
    """
    if not levels:
        return lists.select("chunk", F.array().cast("array<string>").alias("state"))
    grouped = lists.withColumn("group", F.floor(F.col("chunk") / wide))

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": frame["group"].iloc[:1], "keys": [_latest(frame.sort_values("chunk")["keys"], most)]})

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = list(frame["state"].iloc[0]), []
        for c, keys in sorted(zip(frame["chunk"], frame["keys"], strict=True)):
            out.append((c, state))
            state = _latest([state, keys], most)
        return pd.DataFrame(out, columns=["chunk", "state"])

    above = _starts(grouped.groupBy("group").applyInPandas(sums, "chunk bigint, keys array<string>"), most, wide, levels - 1)
    begun = grouped.join(above.withColumnRenamed("chunk", "group"), "group")
    return begun.groupBy("group").applyInPandas(within, "chunk bigint, state array<string>")


def lru_distances(trace: DataFrame, key: str, seq: str, most: int, chunk: int = 4096, wide: int = 256) -> DataFrame:
    """(seq, key, distance): how many other keys came since the key's last access, up to ``most`` - 1; null if more, or never.

    A cache of C <= most entries hits where distance < C, so one pass gives the whole miss curve. An LRU list of
    ``most`` keys is determined by the last accesses before a moment, so chunks of the trace start from a list made of
    the chunks before: each chunk keeps its last ``most`` keys, these lists are summed up by a tree of ``wide`` branches, then all
    chunks replay in parallel. ``seq`` counts from 0 on; gaps cost only groups that are not full.
    """
    if most < 1:
        raise ValueError("a cache holds one key or more")
    cut = trace.select(F.col(seq).cast("bigint").alias("seq"), F.col(key).cast("string").alias("key")).withColumn("chunk", F.floor(F.col("seq") / chunk))
    last = cut.groupBy("chunk", "key").agg(F.max("seq").alias("seq"))
    kept = last.withColumn("n", F.row_number().over(W.partitionBy("chunk").orderBy(F.desc("seq")))).where(F.col("n") <= most)
    lists = kept.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("keys"))
    ends = cut.agg(F.min("chunk"), F.max("chunk")).first()
    levels, lo, hi = 0, ends[0] or 0, ends[1] or 0
    if lo < 0:
        raise ValueError("places in a trace count from 0 on")
    while lo != hi:
        levels, lo, hi = levels + 1, lo // wide, hi // wide
    starts = _starts(lists, most, wide, levels)

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        state, out = list(frame["state"].iloc[0]), []
        for k in frame["key"]:
            at = state.index(k) if k in state else None
            if at is not None:
                state.pop(at)
            state.insert(0, k)
            del state[most:]
            out.append(at)
        return pd.DataFrame({"seq": frame["seq"], "key": frame["key"], "distance": pd.array(out, "Int64")})

    return cut.join(starts, "chunk").groupBy("chunk").applyInPandas(replay, "seq bigint, key string, distance bigint")


def lru_curve(distances: DataFrame, capacities: list[int], most: int | None = None) -> DataFrame:
    """(capacity, hits, misses, evictions): a miss beyond the capacity evicts. ``most``: what lru_distances was given; beyond it
    distances are unknown."""
    if min(capacities) < 1 or (most is not None and max(capacities) > most):
        raise ValueError("capacities go from 1 to the most that the distances were made for")
    table = F.explode(F.array(*[F.lit(c).cast("bigint") for c in capacities]))
    counted = distances.select("distance", table.alias("capacity")).groupBy("capacity").agg(F.count_if(F.col("distance") < F.col("capacity")).alias("hits"), F.count(F.lit(1)).alias("all"))
    misses = F.col("all") - F.col("hits")
    return counted.select("capacity", "hits", misses.alias("misses"), F.greatest(misses - F.col("capacity"), F.lit(0).cast("bigint")).alias("evictions"))


def lru_content(trace: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """What an LRU cache holds in the end, least recent first: the last ``capacity`` keys by last access."""
    last = trace.groupBy(key).agg(F.max(seq).alias("last")).orderBy(F.desc("last")).limit(capacity)
    return last.select(key, (F.row_number().over(W.orderBy("last")) - 1).cast("bigint").alias("place"))


def policies(trace: DataFrame, key: str, seq: str, capacity: int, names: list[str], instance: str | None = None, phase: str | None = None) -> DataFrame:
    """(instance, policy, accesses, hits): each cache instance's trace through all policies, one task for each instance.

    Policies that aren't stack algorithms need one instance's accesses in order; they are read once as a stream of
    sorted batches, and only the caches themselves are held. ``phase``: only rows with "measure" count, all change the caches.
    """
    from .policies import REPLAY_SCHEMA, replay_batches

    name = F.col(instance).cast("string") if instance else F.lit("cache")
    counts = F.col(phase) == "measure" if phase else F.lit(True)
    rows = trace.select(name.alias("instance"), F.col(seq).cast("bigint").alias("seq"), F.col(key).cast("string").alias("key"), counts.alias("counts"))
    dealt = rows.repartition("instance").sortWithinPartitions("instance", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return replay_batches(batches, capacity, names)

    return dealt.mapInPandas(run, REPLAY_SCHEMA)

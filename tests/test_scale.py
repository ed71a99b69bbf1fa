"""Long histories of one key, plans without pairs or one ordered pass over everything, and limits that are checked."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import leaderboard, membership, replay, writes


def plainly(rows, inclusive):
    """hit of each (key, at, order, ttl) in the order of time."""
    ends, out = {}, {}
    for key, at, order, ttl in sorted(rows, key=lambda r: (r[1], r[2])):
        end = ends.get(key, "none")
        hit = end != "none" and (end is None or (at < end if inclusive else at <= end))
        if not hit:
            ends[key] = None if ttl is None else at + ttl
        out[order] = hit
    return out


@pytest.mark.parametrize("inclusive", [False, True])
def test_replay_against_plain(spark, inclusive):
    rng = random.Random(inclusive)
    rows = [(rng.choice("abcde"), rng.randrange(200), i, rng.choice([0, 1, 5, 40, None] if i % 50 == 0 else [0, 1, 5, 40])) for i in range(1500)]
    trace = spark.createDataFrame(rows, "key string, at long, seq long, ttl long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["seq"]: r["hit"] for r in replay.ttl_replay(trace, "key", "at", "seq", F.col("ttl"), inclusive).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plainly(rows, inclusive)


def test_one_key_of_a_million_accesses(spark):
    trace = spark.range(1_000_000).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.col("id").alias("seq"))
    made = replay.ttl_replay(trace, "key", "at", "seq", 9)
    assert made.where("not hit").count() == 100_000


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(leaderboard, "TASK", 20)
    rng = random.Random(5)
    rows = [(f"m{i}", rng.choice([1, 2, 2, 2, 3, 50, rng.randrange(100)])) for i in range(600)]
    board = spark.createDataFrame(rows, "member string, score long")
    got = {r["member"]: (r["position"], r["competition"], r["dense"]) for r in leaderboard.ranked(board, "member").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    scores = sorted({s for _, s in rows}, reverse=True)
    want = {m: (i, 1 + sum(x > s for _, x in rows), 1 + scores.index(s)) for i, (m, s) in enumerate(order)}
    assert got == want
    assert leaderboard.ranked(board.limit(0), "member").count() == 0


def test_ranks_without_a_score_come_last(spark):
    board = spark.createDataFrame([("a", None), ("b", 3), ("c", -1), ("d", None), ("e", 3)], "member string, score long")
    ranks = {r["member"]: (r["position"], r["competition"], r["dense"]) for r in leaderboard.ranked(board, "member").collect()}
    assert ranks == {"b": (0, 1, 1), "e": (1, 1, 1), "c": (2, 3, 2), "a": (3, 4, 3), "d": (4, 4, 3)}


def test_ranks_need_no_single_task(spark):
    board = spark.range(1000).select(F.col("id").alias("member"), (F.col("id") % 97).alias("score"))
    plan = leaderboard.ranked(board, "member")._jdf.queryExecution().executedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "Window [" in line)


def test_nothing_is_paired(spark):
    reads = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "key int, ts long")
    made = spark.createDataFrame([(1, 9), (1, 40), (2, 2), (3, 1)], "key int, created long")
    hidden = membership.invisible(reads, made, "key", "ts", "created", 10)
    assert [tuple(r) for r in hidden.collect()] == [(1, 9, 19)]
    fills = spark.createDataFrame([(1, 1, 10, 20), (1, 2, 20, 30), (2, 3, 0, 5)], "key int, fill_id int, read_at long, filled_at long")
    wrote = spark.createDataFrame([(1, 10), (1, 15), (1, 20), (1, 26), (2, 9)], "key int, written_at long")
    stale = writes.staleness(fills, wrote, "key", 8, 100)
    assert sorted(tuple(r) for r in stale.collect()) == [(1, 1, 3), (1, 2, 4)]
    assert all("Join" not in x._jdf.queryExecution().executedPlan().toString() for x in (hidden, stale))


def test_capacities_are_checked(spark):
    trace = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "key string, seq long")
    with pytest.raises(ValueError, match="one key"):
        replay.lru_distances(trace, "key", "seq", 0)
    with pytest.raises(ValueError, match="capacities"):
        replay.lru_curve(replay.lru_distances(trace, "key", "seq", 4), [8], most=4)

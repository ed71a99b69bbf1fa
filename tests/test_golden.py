"""Small cases whose results can be worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import sizing
from tidewater.functions.hashing import bloom_slots, hash32, shard_of
from tidewater.operators import expiry, hotkeys, inventory, leaderboard, membership, placement, replay, resilience, writes
from tidewater.operators.policies import POLICIES, Sketch
from tidewater.sources import traces


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def python_hash32(text):
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & 0xFFFFFFFF
    return h ^ (h >> 16)


def test_hashes(spark):
    keys = ["", "a", "node-A#0", "key:123", "user:1000"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert dict(df.select("k", hash32(F.col("k"))).collect()) == {k: python_hash32(k) for k in keys}
    assert df.where(hash32(F.lit(None).cast("string")).isNotNull()).count() == 0
    for k, s in df.select("k", shard_of(F.col("k"), 8)).collect():
        h = 5381
        for c in k:
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        assert s == abs(h - (1 << 32) if h >= 1 << 31 else h) % 8
    assert all(len(s) == 7 and all(0 <= x < 9600 for x in s) for (s,) in df.select(bloom_slots(F.col("k"), 9600, 7)).collect())


def test_ttl_demo(spark):
    """14 reads with a life of a second and a pause of 1.1 s: 11 hits, 3 misses."""
    trace = [(i, 0 if i < 9 else 1200, 1 if i % 3 else 2) for i in range(13)]
    trace = [(i, at, key) for i, at, key in trace if not (at and key == 2)] + [(20, 1300, 1)]
    replayed = replay.ttl_replay(spark.createDataFrame(trace, "seq long, at long, key int"), "key", "at", "seq", 1000)
    hits = {r["seq"]: r["hit"] for r in replayed.collect()}
    first = {}
    for i, at, key in sorted(trace, key=lambda x: (x[1], x[0])):
        want = key in first and at <= first[key] + 1000
        if not want:
            first[key] = at
        assert hits[i] == want
    both = spark.createDataFrame([(0, 0, 1), (1, 1000, 1)], "seq long, at long, key int")
    assert rows(replay.ttl_replay(both, "key", "at", "seq", 1000), "hit") == [(False,), (True,)]
    assert rows(replay.ttl_replay(both, "key", "at", "seq", 1000, inclusive=True), "hit") == [(False,), (False,)]
    assert rows(replay.ttl_replay(both, "key", "at", "seq", None), "hit") == [(False,), (True,)]
    assert rows(replay.stats(replay.ttl_replay(both.limit(0), "key", "at", "seq", 5))) == [(0, 0, 0.0)]


def test_lru(spark):
    ops = spark.createDataFrame(list(enumerate(["a", "b", "c", "a", "d", "e"])), "seq long, key string")
    assert rows(replay.lru_content(ops, "key", "seq", 3)) == [("a", 0), ("d", 1), ("e", 2)]
    assert rows(replay.lru_curve(replay.lru_distances(ops, "key", "seq", 8, chunk=2), [3])) == [(3, 1, 5, 2)]


def test_lru_chunks_agree(spark):
    trace = traces.zipf(spark, 600, 40)
    distances = {r["seq"]: r["distance"] for r in replay.lru_distances(trace, "key", "seq", 16, chunk=7, wide=3).collect()}
    state = []
    for seq, key in sorted(tuple(r) for r in trace.collect()):
        at = state.index(key) if key in state else None
        if at is not None:
            state.pop(at)
        state.insert(0, key)
        assert distances[seq] == (at if at is not None and at < 16 else None)


def test_scan_workload(spark):
    got = {r["policy"]: (r["accesses"], r["hits"]) for r in replay.policies(traces.scan(spark), "key", "seq", 16, list(POLICIES), phase="phase").collect()}
    assert got["fifo"] == (452, 0) and got["lru"] == (452, 0) and got["lfu"] == (452, 152)
    assert got["w-tinylfu"][1] >= got["lru"][1]


def test_sketch_ages():
    s = Sketch(128, 10)
    for _ in range(9):
        s.add("x")
    assert s.estimate("x") == 9
    s.add("x")
    assert s.estimate("x") == 5 and s.added == 5


def test_writes(spark):
    log = spark.createDataFrame([(0, "balance", 300), (1, "balance", 350), (2, "views", 1)], "seq long, key string, value int").withColumn("epoch", F.lit(0))
    assert rows(writes.flushes(log, "key", "seq", "value", "epoch"), "key", "value", "saved") == [("balance", 350, 1), ("views", 1, 0)]
    assert writes.lost(log, "seq", 1).count() == 1
    both = spark.createDataFrame([(0, "k", 2), (1, "k", 1), (2, "k", 2), (3, "k", 3)], "seq long, key string, version int")
    assert rows(writes.versioned(both, "key", "seq", "version"), "seq", "accepted") == [(0, True), (1, False), (2, False), (3, True)]
    reads = spark.createDataFrame([(i, i, "p", i == 3) for i in range(7)], "seq long, at long, key string, w boolean")
    assert rows(writes.cache_aside(reads, "key", "seq", "at", "w", 60).groupBy("hit").count()) == [(False, 2), (True, 4)]


def test_stampedes(spark):
    burst = spark.createDataFrame([(i, 0, "k") for i in range(50)], "seq long, at long, key string")
    assert rows(expiry.naive_loads(burst, "key", "at", 200), "loads") == [(50,)]
    assert rows(replay.ttl_replay(burst, "key", "at", "seq", 200).groupBy("hit").count()) == [(False, 1), (True, 49)]
    assert rows(expiry.stale_while_revalidate(burst, "key", "at", "seq", 200, 5000).groupBy("stale", "refresh").count()) == [(True, False, 49), (True, True, 1)]
    readers = spark.range(300).select(F.floor(F.col("id") / 10).alias("tick"), (F.col("id") % 10).alias("reader"))
    assert rows(expiry.hard_herd(readers, "tick", 10)) == [(10, 10), (20, 10)]


def test_early_refreshes_step_by_step(spark):
    import hashlib
    import math

    readers = spark.range(300).select(F.floor(F.col("id") / 10).alias("tick"), (F.col("id") % 10).alias("reader"))
    want = []
    for beta in (0.5, 4.0):
        end = 10
        for t in range(30):
            for r in range(10):
                u = 1 - int(hashlib.md5(f"xfetch|{t}|{r}".encode()).hexdigest()[:8], 16) / 2**32
                if t - 2.0 * beta * math.log(u) >= end:
                    end = t + 10
                    want.append((beta, t, r))
    assert rows(expiry.early_refreshes(readers, "tick", "reader", 10, 2.0, [0.5, 4.0])) == want


def test_placement(spark):
    keys = spark.range(2000).select(F.concat(F.lit("key:"), "id").alias("key"))
    nodes = spark.createDataFrame([(f"node-{c}",) for c in "ABCD"], "node string")
    four = placement.ring(nodes, 100)
    five = four.unionByName(placement.ring(spark.createDataFrame([("node-E",)], "node string"), 100))
    before, after = placement.owners(keys, "key", four), placement.owners(keys, "key", five)
    points = sorted(tuple(r) for r in four.select("hash", "node").collect())
    for key, node in before.select("key", "node").collect():
        h = python_hash32(key)
        assert node == next((n for p, n in points if p >= h), points[0][1])
    moved = before.alias("a").join(after.alias("b"), "key").where("a.node != b.node")
    assert [r[0] for r in moved.select("b.node").distinct().collect()] == ["node-E"]
    back = placement.owners(keys, "key", placement.without(five, "node-E"))
    assert rows(placement.remapped(before, back, "key"), "moved") == [(0,)]
    assert rows(placement.ring_remapped(keys, "key", four, five)) == rows(placement.remapped(before, after, "key"))
    assert rows(placement.ring_remapped(keys.limit(0), "key", four, five)) == [(0, 0, 0.0)]


def test_shares_of_moved_keys(spark):
    """Of 10,000 keys about four fifths move by modulo from four nodes to five, and about 22 % on a ring of 100 points each."""
    keys = spark.range(10_000).select(F.concat(F.lit("key:"), "id").alias("key"))
    by_modulo = placement.moved(keys.select(placement.modulo(F.col("key"), 4).alias("was"), placement.modulo(F.col("key"), 5).alias("node")))
    assert 0.78 < by_modulo.first()["fraction"] < 0.82
    nodes = spark.createDataFrame([(f"node-{c}",) for c in "ABCD"], "node string")
    four = placement.ring(nodes, 100)
    five = four.unionByName(placement.ring(spark.createDataFrame([("node-E",)], "node string"), 100))
    assert 0.17 < placement.ring_remapped(keys, "key", four, five).first()["fraction"] < 0.25


def test_hot_keys(spark):
    traffic = spark.range(1000).select("id", F.when(F.col("id") % 10 != 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    assert rows(hotkeys.heavy_hitters(traffic, "key", 1)) == [("hot", 900)]
    assert rows(hotkeys.sharded_counter(traffic, "key", F.lit(1), "id", 8).where("key = 'hot'"), "total") == [(900,)]
    near = hotkeys.near_cache_loads(traffic, "key", F.col("id") % 4)
    assert rows(near.where("key = 'hot'"), "requests", "loads") == [(900, 4)]
    one = hotkeys.shard_load(traffic, "key", 8).agg(F.max("requests")).first()[0]
    assert hotkeys.replica_spread(traffic, "key", "id", 8, 8).agg(F.max("requests")).first()[0] < one


def test_near_cache_with_a_life(spark):
    reads = spark.createDataFrame([("k", s, at, i) for i, (s, at) in enumerate([(0, 0), (1, 0), (0, 5), (0, 11), (1, 10), (1, 30)])], "key string, server int, at long, seq long")
    assert rows(hotkeys.near_cache_ttl(reads, "key", F.col("server"), "at", "seq", 10)) == [("k", 6, 4)]


def test_count_min_of_any_integer(spark):
    wanted = {0: 3, -1: 5, 7: 1, 2**40 + 3: 2, -(2**62): 4, 2**61 + 12345: 6}
    traffic = spark.createDataFrame([(k,) for k, n in wanted.items() for _ in range(n)], "key long")
    made = hotkeys.count_min(traffic, "key", 0.001, 0.99)
    assert dict(map(tuple, hotkeys.count_min_estimates(traffic, "key", made).collect())) == wanted
    crowd = spark.range(20_000).select(F.col("id").alias("key"))
    off = hotkeys.count_min_estimates(crowd, "key", hotkeys.count_min(crowd, "key", 0.001, 0.99)).agg(F.min("estimate"), F.max("estimate")).first()
    assert off[0] >= 1 and off[1] <= 1 + 20


def test_count_min_settles_keys_that_share_counters(spark):
    """20,000 keys on rows of 200 counters share all of them; ten keys on rows of 2,000 don't. A null is a key too."""
    crowd = spark.range(40_000).select(F.when(F.col("id") != 5, F.col("id") % 20_000).alias("key"))
    made = hotkeys.count_min(crowd, "key", 0.01, 0.99)
    assert hotkeys.count_min_estimates(crowd, "key", made).agg(F.max("estimate")).first()[0] > 2
    settled = dict(map(tuple, hotkeys.count_min_settled(crowd, "key", made).collect()))
    assert settled == {k: 2 for k in range(20_000)} | {5: 1, None: 1}
    few = crowd.where("key < 10")
    assert dict(map(tuple, hotkeys.count_min_settled(few, "key", hotkeys.count_min(few, "key", 0.001, 0.99)).collect())) == {k: 1 + (k != 5) for k in range(10)}


def test_bloom_has_no_false_negatives(spark):
    there = spark.range(1000, 2000).select(F.concat(F.lit("user:"), "id").alias("key"))
    bits = membership.slots(there, "key", 9600, 7)
    assert membership.might_contain(there, "key", bits, 9600, 7).where("not maybe").count() == 0
    none = spark.range(9_000_000, 9_000_500).select(F.concat(F.lit("user:"), "id").alias("key"))
    assert membership.might_contain(none, "key", bits, 9600, 7).where("maybe").count() < 25
    assert membership.might_contain(none, "key", bits.limit(0), 9600, 7).where("maybe").count() == 0


def test_sizing(spark):
    one = spark.range(1)
    assert one.select(sizing.db_qps(F.lit(100000.0), F.lit(0.5))).first()[0] == 50000
    need = sizing.memory_bytes(F.lit(50e6), F.lit(2048.0), F.lit(0.3), F.lit(2.0), F.lit(0.3))
    assert round(one.select(need / 2**30).first()[0], 1) == 322.3
    assert one.select(sizing.node_count(need, F.lit(64.0 * 2**30))).first()[0] == 6
    assert one.select(sizing.avg_latency(F.lit(0.5), F.lit(1.0), F.lit(50.0))).first()[0] == 25.5


def test_resilience(spark):
    n = spark.createDataFrame([(60,), (90,), (120,), (500,)], "n long")
    assert rows(n.select("n", resilience.goodput(F.col("n"), 60))) == [(60, 60), (90, 30), (120, 0), (500, 0)]
    down = spark.range(1, 13).select(F.lit("db").alias("dep"), F.col("id").alias("round"), F.col("id").between(3, 7).alias("failed"))
    states = [s for _, s in rows(resilience.breaker(down, "dep", "round", F.col("failed"), 2, 2), "round", "state")]
    assert states == ["closed"] * 4 + ["open", "half-open", "open", "half-open"] + ["closed"] * 4


def test_inventory(spark):
    asks = spark.range(1000).select(F.lit("x").alias("item"), F.col("id").alias("seq"))
    assert rows(inventory.oversold(asks, "item", 5)) == [("x", 1000, 995, 4)]
    assert rows(inventory.outcomes(inventory.gate(asks, "item", "seq", F.lit(5)))) == [(5, 995)]
    assert rows(inventory.gate_outcomes(asks, "item", F.lit(5))) == [(5, 995)]
    assert rows(inventory.queued(asks, "item", "seq", 3).where("turn <= 4"), "turn", "token") == [(1, 1), (2, 2), (3, 3), (4, None)]
    ops = [(0, "reserve", f"r{i}") for i in range(10)] + [(1, "confirm", f"r{i}") for i in range(6)] + [(2, "release", "r6"), (2, "release", "r6"), (6, "sweep", None), (6, "reserve", "r10"), (6, "confirm", "r10")]
    log = spark.createDataFrame([("x", i, *o) for i, o in enumerate(ops)], "item string, seq long, tick long, op string, id string")
    ledger = inventory.ledger(log, "item", "seq", "tick", "op", "id", 10, 5)
    state = {r["seq"]: (r["available"], r["live"], r["confirmed"]) for r in ledger.collect()}
    assert [state[i] for i in (9, 15, 16, 17, 18, 20)] == [(0, 10, 0), (0, 4, 6), (1, 3, 6), (1, 3, 6), (4, 0, 6), (3, 0, 7)]
    assert inventory.identity(ledger, 10).where("not balanced").count() == 0
    takes = spark.createDataFrame([("x", 0, 4.0), ("x", 1, 9.0), ("x", 2, 1.0)], "item string, seq long, qty double")
    assert rows(inventory.greedy(takes, "item", "seq", "qty", 5.0), "won") == [(False,), (True,), (True,)]


def test_boards(spark):
    tied = spark.createDataFrame([("ana", 100), ("ben", 100), ("cat", 100), ("dov", 90)], "member string, score long")
    assert rows(leaderboard.ranked(tied, "member", member_desc=True), "member", "position", "competition", "dense") == [("ana", 2, 1, 1), ("ben", 1, 1, 1), ("cat", 0, 1, 1), ("dov", 3, 4, 2)]
    assert rows(leaderboard.rank_by_counts(tied, "member"), "member", "competition", "dense") == [("ana", 1, 1), ("ben", 1, 1), ("cat", 1, 1), ("dov", 4, 2)]
    code = leaderboard.composite(F.lit(1234), F.lit(77))
    assert spark.range(1).select(leaderboard.composite_points(code), leaderboard.composite_minute(code)).first()[:] == (1234, 77)
    retries = spark.createDataFrame([(1, 0, 75), (1, 1, 75), (2, 2, 5)], "event_id long, delivery long, points long")
    assert leaderboard.first_deliveries(retries, "event_id", "delivery").agg(F.sum("points")).first()[0] == 80
    late = spark.createDataFrame([("m", 500), ("m", 800), ("m", 700)], "member string, score long")
    assert rows(leaderboard.best(late, "member", "score")) == [("m", 800)]


def test_what_upserts_return(spark):
    log = spark.createDataFrame([("m", i, s) for i, s in enumerate([5, 5, 8, 7, 8, 9])], "member string, seq long, score long")
    assert [c for _, c in rows(leaderboard.changes(log, "member", "score", "seq"), "seq", "changed")] == [True, False, True, True, True, True]
    assert [c for _, c in rows(leaderboard.changes(log, "member", "score", "seq", greater=True), "seq", "changed")] == [True, False, True, False, False, True]


def test_snapshots_replace_their_own_day(spark, tmp_path):
    day = lambda d, points: spark.createDataFrame([(d, m, p) for m, p in points], "day string, member string, score long").select(F.to_date("day").alias("period"), "member", "score")
    path = str(tmp_path / "boards")
    leaderboard.snapshot(day("2024-01-01", [("a", 5), ("b", 5), ("c", 1)]).unionByName(day("2024-01-02", [("a", 1)])), "member", path)
    again = leaderboard.snapshot(day("2024-01-02", [("b", 4), ("a", 2)]), "member", path)
    assert rows(again) == [("2024-01-01", "a", 5, 1), ("2024-01-01", "b", 5, 1), ("2024-01-01", "c", 1, 2), ("2024-01-02", "a", 2, 2), ("2024-01-02", "b", 4, 1)]


def test_least_used_goes_against_a_scan():
    import random

    rng = random.Random(3)
    lfu, uses, born = POLICIES["lfu"](5), {}, {}
    for i in range(4000):
        key = f"k{int(rng.random() ** 2 * 14)}"
        hit = key in uses
        if hit:
            uses[key] += 1
        else:
            if len(uses) == 5:
                gone = min(uses, key=lambda k: (uses[k], born[k]))
                del uses[gone], born[gone]
            uses[key], born[key] = 1, i
        assert lfu.access(key) == hit and set(lfu.count) == set(uses)

"""Queries on placement, hot keys, membership and sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sizing as S
from ..functions.hashing import bloom_slots, djb2, fnv1a, hash32, sdbm
from ..operators import hotkeys as H
from ..operators import membership as M
from ..operators import placement as P
from .base import Book, table
from .caches import TICK, trace, ttl_sql
from .sqlparts import coin as sql_coin
from .sqlparts import djb2 as sql_djb2
from .sqlparts import fnv1a as sql_fnv1a
from .sqlparts import hash32_table, sdbm as sql_sdbm
from .sqlparts import shard_of as sql_shard
from .sqlparts import slots as sql_slots

BOOK = Book()
KEYS = "(SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer)"
NODES = ("node-A", "node-B", "node-C", "node-D")


def customers(spark, d):
    return table(spark, d, "customer", "c_custkey")


def nodes(spark, names=NODES):
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("node"))


@BOOK.add(f"SELECT c_custkey, h AS hash, {sql_fnv1a('k')} AS fnv, {sql_djb2('k')} AS djb, {sql_sdbm('k')} AS sdbm FROM {hash32_table(KEYS, 'k')}")
def hash_values(spark, d):
    k = F.col("c_custkey").cast("string")
    return customers(spark, d).select("c_custkey", hash32(k).alias("hash"), fnv1a(k).alias("fnv"), djb2(k).alias("djb"), sdbm(k).alias("sdbm"))


@BOOK.add(f"SELECT count(*) AS keys, count_if(h % 4 <> h % 5)::BIGINT AS moved, count_if(h % 4 <> h % 5) / count(*) AS fraction FROM {hash32_table(KEYS, 'k')}")
def modulo_remap(spark, d):
    k = F.col("c_custkey").cast("string")
    return P.moved(customers(spark, d).select(P.modulo(k, 4).alias("was"), P.modulo(k, 5).alias("node")))


def _ring_sql(names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return hash32_table(f"(SELECT node, node || '#' || v AS p FROM (SELECT unnest([{listed}]) AS node), (SELECT unnest(range(100)) AS v))", "p")


def _owner_sql(names) -> str:
    """As-of join, then the wrap: keys beyond the last point go to the first."""
    return f"""(SELECT k.c_custkey, k.h AS hash, coalesce(r.node, (SELECT arg_min(node, h) FROM {_ring_sql(names)})) AS node
FROM {hash32_table(KEYS, 'k')} k ASOF LEFT JOIN (SELECT node, h FROM {_ring_sql(names)}) r ON k.h <= r.h)"""


@BOOK.add(f"SELECT node, h AS hash FROM {_ring_sql(NODES)}")
def ring_points(spark, d):
    return P.ring(nodes(spark))


@BOOK.add(f"SELECT c_custkey, hash, node FROM {_owner_sql(NODES)}")
def ring_assign(spark, d):
    return P.owners(customers(spark, d), "c_custkey", P.ring(nodes(spark)))


@BOOK.add(f"SELECT node, count(*) AS keys FROM {_owner_sql(NODES)} GROUP BY node")
def ring_spread(spark, d):
    return P.owners(customers(spark, d), "c_custkey", P.ring(nodes(spark))).groupBy("node").agg(F.count(F.lit(1)).alias("keys"))


def _remap_sql(a, b) -> str:
    return f"SELECT count(*) AS keys, count_if(a.node <> b.node)::BIGINT AS moved, count_if(a.node <> b.node) / count(*) AS fraction FROM {_owner_sql(a)} a JOIN {_owner_sql(b)} b USING (c_custkey)"


@BOOK.add(_remap_sql(NODES, (*NODES, "node-E")))
def ring_add_remap(spark, d):
    keys, four = customers(spark, d), P.ring(nodes(spark))
    return P.ring_remapped(keys, "c_custkey", four, four.unionByName(P.ring(nodes(spark, ("node-E",)))))


@BOOK.add(_remap_sql((*NODES, "node-E"), ("node-A", "node-B", "node-D", "node-E")))
def ring_remove_remap(spark, d):
    keys, five = customers(spark, d), P.ring(nodes(spark, (*NODES, "node-E")))
    return P.ring_remapped(keys, "c_custkey", five, P.without(five, "node-C"))


def parts(spark, d):
    return table(spark, d, "lineitem", "l_partkey")


@BOOK.add("SELECT l_partkey, count(*) AS requests FROM lineitem GROUP BY 1")
def key_counts(spark, d):
    return H.key_counts(parts(spark, d), "l_partkey")


@BOOK.add("SELECT l_partkey, count(*) AS requests FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def heavy_hitters(spark, d):
    return H.heavy_hitters(parts(spark, d), "l_partkey", 20)


@BOOK.add()
def heavy_hitters_approx(spark, d):
    return H.heavy_hitters_approx(parts(spark, d), "l_partkey", 20)


_LOADS = f"SELECT {sql_shard('k', 8)} AS shard, sum(n)::BIGINT AS requests FROM (SELECT l_partkey::VARCHAR AS k, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1"


@BOOK.add(f"SELECT *, row_number() OVER (ORDER BY requests DESC, shard) = 1 AS hottest FROM ({_LOADS})")
def shard_load(spark, d):
    return H.shard_load(parts(spark, d), "l_partkey", 8)


@BOOK.add(f"SELECT shard, requests, requests / sum(requests) OVER () AS share, round(requests / sum(requests) OVER () * 8, 9) AS times_fair FROM ({_LOADS})")
def traffic_share(spark, d):
    return H.traffic_share(H.shard_load(parts(spark, d), "l_partkey", 8), 8).withColumn("times_fair", F.round("times_fair", 9))


@BOOK.add("SELECT user_id, count(*) AS requests, count(DISTINCT event_id % 4) AS loads FROM events GROUP BY user_id")
def near_cache_loads(spark, d):
    return H.near_cache_loads(table(spark, d, "events", "event_id", "user_id"), "user_id", F.pmod("event_id", F.lit(4)))


_NEAR = f"(SELECT event_type || '@' || event_id % 4 AS copy, event_type, event_id, {TICK} AS tick, 1800::BIGINT AS ttl FROM events)"


@BOOK.add(f"{ttl_sql(_NEAR, 'copy', 'ttl')} SELECT split_part(copy, '@', 1) AS event_type, count(*) AS requests, count_if(NOT hit)::BIGINT AS loads FROM r GROUP BY 1")
def near_cache_ttl(spark, d):
    """Four servers keep what they read for half an hour."""
    return H.near_cache_ttl(trace(spark, d), "event_type", F.pmod("event_id", F.lit(4)), "tick", "event_id", 1800)


_COPY = f"user_id || '#' || floor({sql_coin('replica', 'event_id')} * 4)::BIGINT"


@BOOK.add(f"SELECT *, row_number() OVER (ORDER BY requests DESC, shard) = 1 AS hottest FROM (SELECT {sql_shard('k', 8)} AS shard, sum(n)::BIGINT AS requests FROM (SELECT {_COPY} AS k, count(*) AS n FROM events GROUP BY 1) GROUP BY 1)")
def replica_spread(spark, d):
    return H.replica_spread(table(spark, d, "events", "event_id", "user_id"), "user_id", "event_id", 4, 8)


@BOOK.add(f"SELECT event_type, count(*) AS total, count(DISTINCT floor({sql_coin('counter', 'event_id')} * 16)) AS parts FROM events GROUP BY 1")
def sharded_counter(spark, d):
    return H.sharded_counter(table(spark, d, "events", "event_id", "event_type"), "event_type", F.lit(1).cast("bigint"), "event_id", 16)


@BOOK.add("SELECT event_type, count(*) AS requests FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def counter_reset(spark, d):
    return H.key_counts(H.since(table(spark, d, "events", "event_type", "ts"), "ts", F.lit("2024-01-15").cast("timestamp_ntz")), "event_type")


BITS, PROBES = 9600, 7
LABELLED = "(SELECT DISTINCT doc_id::VARCHAR AS k FROM labels)"
_SLOTS = f"(SELECT DISTINCT unnest({sql_slots('k', BITS, PROBES)}) AS slot FROM {LABELLED})"


def labelled(spark, d):
    return table(spark, d, "labels", "doc_id")


def probed(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    found = M.might_contain(docs, "doc_id", M.slots(labelled(spark, d), "doc_id", BITS, PROBES), BITS, PROBES)
    return M.present(found, labelled(spark, d), "doc_id")


_MAYBE = f"(SELECT doc_id, list_has_all((SELECT list(slot) FROM {_SLOTS}), {sql_slots('doc_id::VARCHAR', BITS, PROBES)}) AS maybe, doc_id IN (SELECT doc_id FROM labels) AS exists FROM documents)"


@BOOK.add(f"SELECT slot FROM {_SLOTS}")
def bloom_slots_set(spark, d):
    return M.slots(labelled(spark, d), "doc_id", BITS, PROBES)


@BOOK.add(f"SELECT doc_id, {sql_slots('doc_id::VARCHAR', BITS, PROBES)} AS slots FROM documents")
def bloom_probe_places(spark, d):
    return table(spark, d, "documents", "doc_id").select("doc_id", bloom_slots(F.col("doc_id").cast("string"), BITS, PROBES).alias("slots"))


@BOOK.add(f"SELECT count(*) / {BITS} AS fill FROM {_SLOTS}")
def bloom_fill(spark, d):
    return M.fill_ratio(M.slots(labelled(spark, d), "doc_id", BITS, PROBES), BITS)


@BOOK.add(f"SELECT doc_id, maybe, exists FROM {_MAYBE}")
def bloom_probe(spark, d):
    return probed(spark, d).select("doc_id", "maybe", "exists")


@BOOK.add(f"SELECT count(*) AS requests, count_if(NOT exists)::BIGINT AS absent, count_if(maybe AND NOT exists)::BIGINT AS false_positives, coalesce(count_if(maybe AND NOT exists) / nullif(count_if(NOT exists), 0), 0.0) AS rate, count_if(exists AND NOT maybe)::BIGINT AS false_negatives FROM {_MAYBE}")
def bloom_fpr(spark, d):
    return M.false_positives(probed(spark, d))


@BOOK.add(f"SELECT CASE WHEN NOT maybe THEN 'filtered' WHEN exists THEN 'found' ELSE 'missed' END AS outcome, count(*) AS requests FROM {_MAYBE} GROUP BY 1")
def guarded_lookup(spark, d):
    outcome = F.when(~F.col("maybe"), "filtered").when(F.col("exists"), "found").otherwise("missed")
    return probed(spark, d).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("requests"))


@BOOK.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def absent_keys(spark, d):
    return M.absent(table(spark, d, "documents", "doc_id"), labelled(spark, d), "doc_id")


@BOOK.add("""SELECT c.user_id AS user_id, c.created, max(r.tick) + 7200 AS visible_at FROM
(SELECT user_id, epoch(ts)::BIGINT AS created FROM events WHERE event_type = 'purchase') c JOIN (SELECT user_id, epoch(ts)::BIGINT AS tick FROM events WHERE event_type = 'view') r
ON c.user_id = r.user_id AND r.tick <= c.created AND c.created < r.tick + 7200 GROUP BY ALL""")
def read_after_create(spark, d):
    e = table(spark, d, "events", "user_id", "ts", "event_type").withColumn("tick", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint"))
    return M.invisible(e.where("event_type = 'view'"), e.where("event_type = 'purchase'").select("user_id", F.col("tick").alias("created")), "user_id", "tick", "created", 7200)


GRID = (0.5, 0.8, 0.9, 0.95, 0.99, 0.999)
_GRID = f"(SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS hit_ratio)"


def grid(spark):
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in GRID])).alias("hit_ratio"))


@BOOK.add(f"SELECT hit_ratio, round(100000.0::DOUBLE * (1.0::DOUBLE - hit_ratio), 6) AS db_qps FROM {_GRID}")
def sizing_db_qps(spark, d):
    return grid(spark).select("hit_ratio", F.round(S.db_qps(F.lit(100000.0), F.col("hit_ratio")), 6).alias("db_qps"))


@BOOK.add(f"SELECT hit_ratio, round(hit_ratio * 1.0::DOUBLE + (1.0::DOUBLE - hit_ratio) * 50.0::DOUBLE, 6) AS latency_ms FROM {_GRID}")
def sizing_latency(spark, d):
    return grid(spark).select("hit_ratio", F.round(S.avg_latency(F.col("hit_ratio"), F.lit(1.0), F.lit(50.0)), 6).alias("latency_ms"))


@BOOK.add(f"SELECT hit_ratio, q AS db_qps, round(lag(q) OVER (ORDER BY hit_ratio) / q, 6) AS times_less FROM (SELECT hit_ratio, round(100000.0::DOUBLE * (1.0::DOUBLE - hit_ratio), 6) AS q FROM {_GRID})")
def sizing_sweep(spark, d):
    from pyspark.sql.window import Window as W

    swept = grid(spark).select("hit_ratio", F.round(S.db_qps(F.lit(100000.0), F.col("hit_ratio")), 6).alias("db_qps"))
    return swept.withColumn("times_less", F.round(F.lag("db_qps").over(W.orderBy("hit_ratio")) / F.col("db_qps"), 6))


@BOOK.add("""SELECT round(b / 1073741824, 6) AS data_gib, round(b * 1.3 / 1073741824, 6) AS with_overhead_gib, round(b * 1.3 * 2 / 1073741824, 6) AS replicated_gib,
round(b * 1.3 * 2 * 1.3 / 1073741824, 6) AS provisioned_gib, ceil(b * 1.3 * 2 * 1.3 / (64 * 1073741824.0::DOUBLE))::BIGINT AS nodes FROM (SELECT (50000000.0 * 2048.0)::DOUBLE AS b)""")
def sizing_memory(spark, d):
    items, size = F.lit(50_000_000.0), F.lit(2048.0)
    gib = lambda over, replicas, head: F.round(S.memory_bytes(items, size, F.lit(over), F.lit(replicas), F.lit(head)) / (1 << 30), 6)
    need = S.memory_bytes(items, size, F.lit(0.3), F.lit(2.0), F.lit(0.3))
    return spark.range(1).select(gib(0.0, 1.0, 0.0).alias("data_gib"), gib(0.3, 1.0, 0.0).alias("with_overhead_gib"), gib(0.3, 2.0, 0.0).alias("replicated_gib"), gib(0.3, 2.0, 0.3).alias("provisioned_gib"), S.node_count(need, F.lit(64.0 * (1 << 30))).alias("nodes"))


@BOOK.add("SELECT nodes, 200000.0::DOUBLE / nodes AS qps_per_node, 200000.0::DOUBLE / nodes <= 100000 AS within_node_limit FROM (SELECT unnest(range(1, 9)) AS nodes)")
def sizing_bound(spark, d):
    per = F.lit(200000.0) / F.col("id")
    return spark.range(1, 9).select(F.col("id").alias("nodes"), per.alias("qps_per_node"), (per <= 100000).alias("within_node_limit"))

"""Queries on write policies, consistency, expiry, resilience and inventory.

The event stream serves as the log: a purchase is a write, a view a read, an error a failure.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import coin
from ..operators import expiry as X
from ..operators import inventory as I
from ..operators import resilience as Z
from ..operators import writes as A
from .base import Book, table
from .caches import TICK, trace, ttl_sql
from .sqlparts import coin as sql_coin

BOOK = Book()
WRITES = "(SELECT * FROM events WHERE event_type = 'purchase')"


def writes(spark, d):
    return trace(spark, d).where("event_type = 'purchase'")


_ERA = f"(SELECT user_id || ':' || era AS unit, user_id, event_id, {TICK} AS tick, 43200::BIGINT AS ttl FROM (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM events) WHERE event_type <> 'purchase')"


@BOOK.add(f"{ttl_sql(_ERA, 'unit', 'ttl')} SELECT o.user_id, r.tick, r.event_id, r.hit FROM r JOIN o ON r.event_id = o.event_id")
def cache_aside(spark, d):
    log = trace(spark, d).withColumn("is_write", F.col("event_type") == "purchase")
    return A.cache_aside(log, "user_id", "event_id", "tick", "is_write", 43200)


@BOOK.add("SELECT user_id AS id, '{\"id\":' || user_id || ',\"n\":' || count(*) || '}' AS value FROM events GROUP BY user_id")
def json_entries(spark, d):
    """Cached values as JSON with a fixed schema, written and read again."""
    rows = table(spark, d, "events", "user_id").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    text = rows.select(F.to_json(F.struct("id", "n")).alias("value"))
    back = text.select("value", F.from_json("value", "id bigint, n bigint").alias("v"))
    return back.select("v.id", F.to_json("v").alias("value"))


@BOOK.add("SELECT key FROM (SELECT event_type || ':' || user_id AS key FROM events GROUP BY 1) WHERE NOT starts_with(key, 'view:')")
def prefix_clear(spark, d):
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    return table(spark, d, "events", "event_type", "user_id").select(key.alias("key")).distinct().where(~F.col("key").startswith("view:"))


@BOOK.add(f"SELECT user_id, arg_max(value, event_id) AS value FROM {WRITES} GROUP BY user_id")
def write_through(spark, d):
    return A.final_values(writes(spark, d), "user_id", "event_id", "value")


@BOOK.add(f"SELECT count(*) AS differing FROM (SELECT user_id, arg_max(value, event_id) AS v FROM {WRITES} GROUP BY 1) a JOIN (SELECT user_id, arg_max(value, event_id) AS v FROM (SELECT * FROM {WRITES} WHERE ts < TIMESTAMP '2024-01-25') GROUP BY 1) b USING (user_id) WHERE a.v <> b.v")
def writeback_drift(spark, d):
    """Keys on which the cache is ahead of a database that was flushed last on 25 January."""
    cache = A.final_values(writes(spark, d), "user_id", "event_id", "value")
    db = A.final_values(writes(spark, d).where(F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz")), "user_id", "event_id", "value")
    return A.differing(cache, db.join(cache.select("user_id"), "user_id", "left_semi")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").agg(F.count(F.lit(1)).alias("differing"))


@BOOK.add(f"SELECT strftime(ts, '%Y-%m-%d') AS epoch, user_id, arg_max(value, event_id) AS value, count(*) - 1 AS saved FROM {WRITES} GROUP BY 1, 2")
def writeback_coalesce(spark, d):
    return A.flushes(writes(spark, d).withColumn("epoch", F.date_format("ts", "yyyy-MM-dd")), "user_id", "event_id", "value", "epoch")


@BOOK.add(f"SELECT count(*) AS lost, count(DISTINCT user_id) AS keys FROM {WRITES} WHERE event_id > 900")
def writeback_loss(spark, d):
    return A.lost(writes(spark, d), "event_id", 900).agg(F.count(F.lit(1)).alias("lost"), F.count_distinct("user_id").alias("keys"))


@BOOK.add(f"SELECT user_id, event_id, version, coalesce(version > max(version) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM (SELECT *, (event_id * 7) % 101 AS version FROM {WRITES})")
def versioned_accept(spark, d):
    log = writes(spark, d).select("user_id", "event_id", F.pmod(F.col("event_id") * 7, F.lit(101)).alias("version"))
    return A.versioned(log, "user_id", "event_id", "version")


_FILLS = f"(SELECT user_id, event_id AS fill_id, {TICK} AS read_at, {TICK} + 14400 AS filled_at FROM events WHERE event_type = 'view')"
_W = f"(SELECT user_id, {TICK} AS written_at FROM events WHERE event_type = 'purchase')"


def fills(spark, d):
    return trace(spark, d).where("event_type = 'view'").select("user_id", F.col("event_id").alias("fill_id"), F.col("tick").alias("read_at"), (F.col("tick") + 14400).alias("filled_at"))


def written(spark, d):
    return writes(spark, d).select("user_id", F.col("tick").alias("written_at"))


@BOOK.add(f"SELECT user_id, fill_id, read_at, filled_at FROM {_FILLS} f WHERE EXISTS (SELECT 1 FROM {_W} w WHERE w.user_id = f.user_id AND w.written_at > f.read_at AND w.written_at <= f.filled_at)")
def stale_fills(spark, d):
    return A.stale_fills(fills(spark, d), written(spark, d), "user_id")


@BOOK.add(f"""WITH m AS (SELECT f.user_id, fill_id, filled_at, min(written_at) FILTER (written_at > read_at AND written_at <= filled_at) AS w, min(written_at) FILTER (written_at > filled_at) AS n
FROM {_FILLS} f JOIN {_W} USING (user_id) GROUP BY ALL)
SELECT user_id, fill_id, least(greatest(w + 15000, filled_at), filled_at + 86400, coalesce(n, filled_at + 86400)) - filled_at AS stale_for FROM m WHERE w IS NOT NULL""")
def staleness_bound(spark, d):
    return A.staleness(fills(spark, d), written(spark, d), "user_id", 15000, 86400)


def requests(spark, d):
    return trace(spark, d).select("event_type", "tick", F.col("event_id").alias("seq"))


_BURSTS = f"{ttl_sql(f'(SELECT event_type, event_id, {TICK} AS tick, 1800::BIGINT AS ttl FROM events)', 'event_type', 'ttl')}, b AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY event_type ORDER BY rn) AS burst FROM r)"


@BOOK.add(f"{_BURSTS} SELECT event_type, burst, count(*) AS loads FROM b GROUP BY 1, 2")
def naive_loads(spark, d):
    return X.naive_loads(requests(spark, d), "event_type", "tick", 1800)


@BOOK.add(f"SELECT max(n) AS peak, count(*) AS seconds FROM (SELECT floor((60000 + floor({sql_coin('jitter', 'c_custkey')} * 10000)) / 1000) AS s, count(*) AS n FROM customer GROUP BY 1)")
def jitter_peak(spark, d):
    return X.expiry_peak(table(spark, d, "customer", "c_custkey"), X.jittered(60000, 10000, F.col("c_custkey")))


@BOOK.add(f"""{ttl_sql(f'(SELECT event_type, event_id, {TICK} AS tick, 2400::BIGINT AS ttl FROM events)', 'event_type', 'ttl')}
SELECT event_type, count(*) AS requests, count_if(NOT hit)::BIGINT AS refreshes, count_if(NOT hit OR tick < loaded + 600)::BIGINT AS stale FROM r GROUP BY 1""")
def stale_while_revalidate(spark, d):
    served = X.stale_while_revalidate(requests(spark, d), "event_type", "tick", "seq", 600, 1800)
    return served.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if("refresh").alias("refreshes"), F.count_if("stale").alias("stale"))


def readers(spark):
    return spark.range(30 * 10).select(F.floor(F.col("id") / 10).alias("tick"), F.pmod("id", F.lit(10)).alias("reader"))


@BOOK.add("SELECT i // 10 AS tick, count(*) AS recomputes FROM range(300) r(i) WHERE i // 10 > 0 AND (i // 10) % 10 = 0 GROUP BY 1")
def hard_ttl_herd(spark, d):
    return X.hard_herd(readers(spark), "tick", 10)


@BOOK.add("SELECT l AS left_ticks, round(least(1.0::DOUBLE, exp(-l / (2.0::DOUBLE * 1.0))), 9) AS probability FROM range(-2, 11) r(l)")
def xfetch_probability(spark, d):
    return spark.range(-2, 11).select(F.col("id").alias("left_ticks"), F.round(X.early_probability(F.col("id"), 2.0, F.lit(1.0)), 9).alias("probability"))


_XFETCH = f"""WITH RECURSIVE c AS (SELECT beta, t AS tick, i AS reader, t - 2.0::DOUBLE * beta * ln(1.0::DOUBLE - {sql_coin('xfetch', 't', 'i')}) AS reach FROM range(30) r(t), range(10) q(i), (SELECT unnest([0.5, 1.0, 2.0, 4.0]::DOUBLE[]) AS beta)),
o AS (SELECT *, row_number() OVER (PARTITION BY beta ORDER BY tick, reader) AS rn FROM c),
x AS (SELECT beta, 0::BIGINT AS rn, 10::BIGINT AS ends, false AS fires, 0::BIGINT AS tick, 0::BIGINT AS reader FROM (SELECT DISTINCT beta FROM c)
UNION ALL SELECT o.beta, o.rn, CASE WHEN o.reach >= x.ends THEN o.tick + 10 ELSE x.ends END, o.reach >= x.ends, o.tick, o.reader FROM x JOIN o ON o.beta = x.beta AND o.rn = x.rn + 1)"""


@BOOK.add(f"{_XFETCH} SELECT beta, tick, reader FROM x WHERE fires")
def xfetch_refreshes(spark, d):
    return X.early_refreshes(readers(spark), "tick", "reader", 10, 2.0, [0.5, 1.0, 2.0, 4.0])


@BOOK.add(f"{_XFETCH} SELECT beta, count(*) AS refreshes, min(tick) AS first_tick FROM x WHERE fires GROUP BY beta")
def beta_sweep(spark, d):
    fired = X.early_refreshes(readers(spark), "tick", "reader", 10, 2.0, [0.5, 1.0, 2.0, 4.0])
    return fired.groupBy("beta").agg(F.count(F.lit(1)).alias("refreshes"), F.min("tick").alias("first_tick"))


@BOOK.add("SELECT n, (CASE WHEN n <= 60 THEN n ELSE greatest(0, 120 - n) END)::BIGINT AS goodput FROM range(0, 150, 10) r(n)")
def goodput(spark, d):
    return spark.range(0, 150, 10).select(F.col("id").alias("n"), Z.goodput(F.col("id"), 60).alias("goodput"))


@BOOK.add(f"""SELECT event_type, max(open)::BIGINT AS peak FROM (SELECT event_type, t, sum(sum(d)) OVER (PARTITION BY event_type ORDER BY t) AS open FROM
(SELECT event_type, {TICK} AS t, 1 AS d FROM events UNION ALL SELECT event_type, {TICK} + 3600, -1 FROM events) GROUP BY 1, 2) GROUP BY 1""")
def peak_in_flight(spark, d):
    return Z.peak_in_flight(trace(spark, d).withColumn("done", F.col("tick") + 3600), "tick", "done", "event_type")


@BOOK.add("SELECT day, count_if(rn <= 60)::BIGINT AS admitted, count_if(rn > 60)::BIGINT AS shed FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def limiter_admit(spark, d):
    days = table(spark, d, "events", "event_id", "ts").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return Z.admitted(days, "day", "event_id", 60).groupBy("day").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("shed"))


_HOURS = f"(SELECT user_id % 10 AS dependency, {TICK} // 21600 AS round, bool_and(event_type = 'error' OR event_type = 'click') AS failed FROM events GROUP BY 1, 2)"


@BOOK.add(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY dependency ORDER BY round) AS rn FROM {_HOURS}),
b AS (SELECT dependency, 0::BIGINT AS rn, -1::BIGINT AS round, 'closed' AS met, 'closed' AS state, 0 AS failures, -1::BIGINT AS opened FROM (SELECT DISTINCT dependency FROM o)
UNION ALL SELECT dependency, rn, round, met, CASE WHEN met = 'open' THEN 'open' WHEN failed AND (met = 'half-open' OR f >= 2) THEN 'open' WHEN failed THEN met ELSE 'closed' END,
CASE WHEN met = 'open' THEN was ELSE f END, CASE WHEN met <> 'open' AND failed AND (met = 'half-open' OR f >= 2) THEN round ELSE opened END FROM
(SELECT o.dependency, o.rn, o.round, o.failed, b.opened, b.failures AS was, CASE WHEN o.failed THEN b.failures + 1 ELSE 0 END AS f,
CASE WHEN b.state = 'open' AND o.round - b.opened >= 2 THEN 'half-open' ELSE b.state END AS met FROM b JOIN o ON o.dependency = b.dependency AND o.rn = b.rn + 1))
SELECT dependency, round, met AS state, met <> 'open' AS allowed FROM b WHERE rn > 0""")
def breaker_trace(spark, d):
    hours = trace(spark, d).groupBy(F.pmod("user_id", F.lit(10)).alias("dependency"), F.floor(F.col("tick") / 21600).alias("round")).agg(F.bool_and(F.col("event_type").isin("error", "click")).alias("failed"))
    return Z.breaker(hours, "dependency", "round", F.col("failed"), 2, 2)


def wave(spark):
    seq = spark.range(12 * 400)
    return seq.select(F.floor(F.col("id") / 400).alias("round"), F.col("id").alias("seq"), F.floor(coin("avalanche", F.col("id")) * 300).alias("key"))


_AVALANCHE = f"""WITH RECURSIVE w AS (SELECT i // 400 AS round, list(floor({sql_coin('avalanche', 'i')} * 300)::BIGINT ORDER BY i) AS ks FROM range(4800) r(i) GROUP BY 1),
m AS (SELECT * FROM (VALUES ('naive'), ('limited')) AS _(mode)),
a AS (SELECT mode, -1::BIGINT AS round, []::BIGINT[] AS warm, []::BIGINT[] AS ks, []::BIGINT[] AS missed, []::BIGINT[] AS sent, 0::BIGINT AS good FROM m
UNION ALL SELECT mode, round, list_distinct(warm || sent[1:good]), ks, missed, sent, good FROM
(SELECT *, CASE WHEN len(sent) <= 60 THEN len(sent) ELSE greatest(0, 120 - len(sent)) END AS good FROM
(SELECT *, CASE WHEN mode = 'naive' THEN missed ELSE missed[1:60] END AS sent FROM
(SELECT a.mode, w.round, a.warm, w.ks, list_filter(w.ks, lambda k: NOT list_contains(a.warm, k)) AS missed FROM a JOIN w ON w.round = a.round + 1)))),
o AS (SELECT mode, round, (len(ks) - len(missed))::BIGINT AS hits, len(sent)::BIGINT AS db_load, good::BIGINT AS goodput, (len(missed) - len(sent))::BIGINT AS shed,
(len(ks) - len(missed) + good)::DOUBLE / len(ks) AS success, len(warm)::BIGINT AS cached FROM a WHERE round >= 0)"""


@BOOK.add(f"{_AVALANCHE} SELECT * FROM o")
def avalanche(spark, d):
    return Z.avalanche(wave(spark), "round", "seq", "key", 60, ["naive", "limited"])


@BOOK.add(f"{_AVALANCHE} SELECT mode, coalesce(min(round) FILTER (success >= 0.95), -1) AS recovered FROM o GROUP BY 1")
def recovery_round(spark, d):
    """The unguarded database never comes back (-1); behind the limiter it does."""
    found = Z.recovery(Z.avalanche(wave(spark), "round", "seq", "key", 60, ["naive", "limited"]))
    return found.select("mode", F.coalesce("recovered", F.lit(-1)).cast("bigint").alias("recovered"))


def orders(spark, d):
    return table(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_extendedprice")


#: A total order of the order lines: (l_orderkey, l_linenumber) alone repeats.
_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity"


def _ordered():
    return F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")


@BOOK.add("SELECT l_partkey, count(*) AS orders, greatest(count(*) - 5, 0)::BIGINT AS oversold, 4::BIGINT AS final_stock FROM lineitem GROUP BY 1")
def oversell(spark, d):
    return I.oversold(orders(spark, d), "l_partkey", 5)


@BOOK.add(f"SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) AS rn FROM lineitem) WHERE rn <= 5")
def gate_winners(spark, d):
    return I.winners(orders(spark, d).withColumn("at", _ordered()), "l_partkey", "at", 5).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@BOOK.add("SELECT user_id, event_id, row_number() OVER w AS turn, CASE WHEN row_number() OVER w <= 5 THEN row_number() OVER w END AS token FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def single_writer(spark, d):
    """The purchases of each user wait in one queue, with five tokens."""
    return I.queued(writes(spark, d).select("user_id", "event_id"), "user_id", "event_id", 5)


@BOOK.add("SELECT sum(least(n, 5))::BIGINT AS winners, sum(n - least(n, 5))::BIGINT AS bounced FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)")
def gate_outcomes(spark, d):
    return I.gate_outcomes(orders(spark, d), "l_partkey", F.lit(5))


_SALES = f"(SELECT user_id AS item, event_id AS seq, {TICK} // 3600 AS tick, (event_id % 7 + 1)::DOUBLE AS qty, event_type FROM events)"


@BOOK.add(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq) AS rn FROM {_SALES}),
g AS (SELECT item, 0::BIGINT AS rn, 0::BIGINT AS seq, 0.0::DOUBLE AS qty, 50.0::DOUBLE AS stock, false AS won FROM (SELECT DISTINCT item FROM o)
UNION ALL SELECT o.item, o.rn, o.seq, o.qty, CASE WHEN o.qty <= g.stock THEN g.stock - o.qty ELSE g.stock END, o.qty <= g.stock FROM g JOIN o ON o.item = g.item AND o.rn = g.rn + 1)
SELECT item, seq, qty, won FROM g WHERE rn > 0""")
def greedy_quantity(spark, d):
    sales = table(spark, d, "events", "event_id", "user_id").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), (F.pmod("event_id", F.lit(7)) + 1).cast("double").alias("qty"))
    return I.greedy(sales, "item", "seq", "qty", 50.0)


#: Reservations r0 to r4 of each item come round: reserve (view), confirm (purchase), release (click), sweep (error), others reserve.
_LOG = f"(SELECT user_id AS item, event_id AS seq, {TICK} // 3600 AS tick, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'click' THEN 'release' WHEN 'error' THEN 'sweep' ELSE 'reserve' END AS op, 'r' || (event_id % 5) AS id FROM events)"
_LEDGER = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq) AS rn FROM {_LOG}),
s AS (SELECT item, 0::BIGINT AS rn, 0::BIGINT AS seq, false AS ok, 3::BIGINT AS available, MAP {{}}::MAP(VARCHAR, BIGINT) AS holds, 0::BIGINT AS confirmed FROM (SELECT DISTINCT item FROM o)
UNION ALL SELECT item, rn, seq, does, available + CASE WHEN does AND op = 'reserve' THEN -1 WHEN does AND op = 'release' THEN 1 WHEN op = 'sweep' THEN n_ended ELSE 0 END,
CASE WHEN does AND op = 'reserve' THEN map_concat(holds, MAP {{id: tick + 48}}) WHEN does AND op IN ('confirm', 'release') THEN map_from_entries(list_filter(map_entries(holds), lambda e: e.key <> id))
WHEN op = 'sweep' THEN map_from_entries(list_filter(map_entries(holds), lambda e: tick < e.value)) ELSE holds END, confirmed + (does AND op = 'confirm')::BIGINT FROM
(SELECT *, CASE op WHEN 'reserve' THEN available > 0 AND held IS NULL WHEN 'confirm' THEN coalesce(tick < held, false) WHEN 'release' THEN held IS NOT NULL ELSE n_ended > 0 END AS does FROM
(SELECT o.item, o.rn, o.seq, o.tick, o.op, o.id, s.available, s.holds, s.confirmed, s.holds[o.id] AS held, len(list_filter(map_values(s.holds), lambda v: o.tick >= v))::BIGINT AS n_ended
FROM s JOIN o ON o.item = s.item AND o.rn = s.rn + 1)))"""


def log(spark, d):
    op = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "click", "release").when(F.col("event_type") == "error", "sweep").otherwise("reserve")
    return trace(spark, d).select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.floor(F.col("tick") / 3600).alias("tick"), op.alias("op"), F.concat(F.lit("r"), F.pmod("event_id", F.lit(5))).alias("id"))


@BOOK.add(f"{_LEDGER} SELECT item, seq, ok, available, cardinality(holds)::BIGINT AS live, confirmed FROM s WHERE rn > 0")
def reservation_ledger(spark, d):
    return I.ledger(log(spark, d), "item", "seq", "tick", "op", "id", 3, 48)


@BOOK.add(f"{_LEDGER} SELECT item, count(*) AS operations, bool_and(available + cardinality(holds)::BIGINT + confirmed = 3) AS balanced FROM s WHERE rn > 0 GROUP BY item")
def stock_identity(spark, d):
    checked = I.identity(I.ledger(log(spark, d), "item", "seq", "tick", "op", "id", 3, 48), 3)
    return checked.groupBy("item").agg(F.count(F.lit(1)).alias("operations"), F.bool_and("balanced").alias("balanced"))


@BOOK.add("SELECT event_type AS topic, least(count(DISTINCT user_id), 120)::BIGINT AS done, 120::BIGINT AS total FROM events GROUP BY 1")
def progress(spark, d):
    """Distinct steps done of a total, never more than that."""
    done = F.least(F.count_distinct("user_id"), F.lit(120)).cast("bigint")
    return table(spark, d, "events", "event_type", "user_id").groupBy(F.col("event_type").alias("topic")).agg(done.alias("done"), F.lit(120).cast("bigint").alias("total"))


@BOOK.add("SELECT count(*) AS cards FROM (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1) WHERE state IS DISTINCT FROM 'purchase'")
def review_filter(spark, d):
    last = table(spark, d, "events", "event_id", "event_type", "user_id").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"))
    return last.where(~F.col("state").eqNullSafe("purchase")).agg(F.count(F.lit(1)).alias("cards"))

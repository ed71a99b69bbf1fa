"""Ranking queries: boards over the event stream and over customers' orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import coin
from ..operators import leaderboard as L
from ..sources.folders import shared_folder
from .base import Book, table
from .sqlparts import coin as sql_coin

BOOK = Book()
BOARD = "SELECT user_id, round(sum(value), 4) AS score FROM events GROUP BY user_id"
#: A board with many equal scores.
COARSE = "SELECT user_id, floor(sum(value) / 250)::BIGINT AS score FROM events GROUP BY user_id"
BY_CUSTOMER = "SELECT o_custkey, n_regionkey, sum(round(o_totalprice))::BIGINT AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"
WIDTH, BUCKETS = 500.0, 20


def events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "events", *columns)


def board(spark: SparkSession, d: str) -> DataFrame:
    once = L.first_deliveries(events(spark, d, "event_id", "ts", "user_id", "value"), "event_id", "ts")
    return L.total(once, "user_id", F.col("value")).withColumn("score", F.round("score", 4))


def coarse(spark: SparkSession, d: str) -> DataFrame:
    return L.floored_totals(events(spark, d, "event_id", "user_id", "value"), ["user_id"], "value", "event_id", 250)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return L.floored_totals(L.periods(events(spark, d, "event_id", "ts", "user_id", "value"), "ts", "day"), ["period", "user_id"], "value", "event_id", 20)


def customers(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "customer", "c_custkey", "c_nationkey").join(table(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    spent = table(spark, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("score"))
    return spent.join(region, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "n_regionkey", "score")


@BOOK.add(f"SELECT user_id, score FROM ({BOARD}) ORDER BY score DESC, user_id LIMIT 10")
def board_topk(spark, d):
    return L.top(board(spark, d), "user_id", 10)


@BOOK.add("SELECT user_id, arg_max(value, event_id) AS score FROM events GROUP BY user_id")
def board_zadd(spark, d):
    return L.latest(events(spark, d, "event_id", "user_id", "value"), "user_id", "value", "event_id")


@BOOK.add("SELECT event_id, user_id, coalesce(floor(value) <> lag(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id), true) AS changed FROM events")
def board_changes(spark, d):
    """What each upsert returns: whether it changed the board."""
    whole = events(spark, d, "event_id", "user_id", "value").withColumn("value", F.floor("value"))
    return L.changes(whole, "user_id", "value", "event_id").select("event_id", "user_id", "changed")


@BOOK.add("SELECT event_id, user_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS changed FROM events")
def max_wins_changes(spark, d):
    return L.changes(events(spark, d, "event_id", "user_id", "value"), "user_id", "value", "event_id", greater=True).select("event_id", "user_id", "changed")


@BOOK.add("SELECT user_id, max(value) AS score FROM events GROUP BY user_id")
def max_wins(spark, d):
    return L.best(events(spark, d, "user_id", "value"), "user_id", "value")


@BOOK.add(f"SELECT i.user_id, b.score FROM (SELECT unnest(range(0, 400, 7)) AS user_id) i LEFT JOIN ({BOARD}) b USING (user_id)")
def board_lookup(spark, d):
    return L.lookup(board(spark, d), spark.range(0, 400, 7).withColumnRenamed("id", "user_id"), "user_id")


@BOOK.add(f"SELECT count(*) AS members FROM ({BOARD})")
def board_card(spark, d):
    return board(spark, d).agg(F.count(F.lit(1)).alias("members"))


@BOOK.add(f"SELECT user_id, score, row_number() OVER (ORDER BY score DESC, user_id DESC) - 1 AS position, rank() OVER (ORDER BY score DESC) AS competition, dense_rank() OVER (ORDER BY score DESC) AS dense FROM ({COARSE})")
def board_ranks(spark, d):
    return L.ranked(coarse(spark, d), "user_id", member_desc=True)


@BOOK.add(f"SELECT user_id, score, rank() OVER (ORDER BY score DESC) AS competition, dense_rank() OVER (ORDER BY score DESC) AS dense FROM ({COARSE})")
def board_ranks_by_counts(spark, d):
    return L.rank_by_counts(coarse(spark, d), "user_id")


@BOOK.add(f"SELECT user_id, score, position FROM (SELECT *, row_number() OVER (ORDER BY score DESC, user_id) - 1 AS position FROM ({BOARD})) WHERE position BETWEEN 10 AND 19")
def board_page(spark, d):
    return L.page(board(spark, d), "user_id", 10, 19)


@BOOK.add(f"SELECT count(*) AS n FROM ({COARSE}) WHERE score > 12")
def board_count_above(spark, d):
    return L.count_above(coarse(spark, d), 12)


@BOOK.add("""SELECT user_id, points, minute, code, row_number() OVER (ORDER BY code DESC, user_id) - 1 AS position FROM
(SELECT user_id, points, minute, points * 4194304 + 4194303 - minute AS code FROM (SELECT user_id, floor(sum(value) / 250)::BIGINT AS points,
(epoch(max(ts)) / 60)::BIGINT % 1000000 AS minute FROM events GROUP BY user_id))""")
def composite_order(spark, d):
    minute = F.pmod(F.round(F.unix_seconds(F.max("ts").cast("timestamp")) / 60).cast("bigint"), F.lit(1000000))
    points = events(spark, d, "user_id", "ts", "value").groupBy("user_id").agg(F.floor(F.sum("value") / 250).alias("points"), minute.alias("minute"))
    coded = points.withColumn("code", L.composite(F.col("points"), F.col("minute")))
    decoded = coded.select("user_id", L.composite_points(F.col("code")).alias("points"), L.composite_minute(F.col("code")).alias("minute"), F.col("code").alias("score"))
    return L.ranked(decoded, "user_id").select("user_id", "points", "minute", F.col("score").alias("code"), "position")


@BOOK.add(f"SELECT user_id, coalesce(score, 0.0) AS score, row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, user_id) - 1 AS position FROM (SELECT unnest([3, 17, 42, 99, 100000]::BIGINT[]) AS user_id) LEFT JOIN ({BOARD}) USING (user_id)")
def friends_board(spark, d):
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("bigint") for i in (3, 17, 42, 99, 100000)])).alias("user_id"))
    return L.friends(board(spark, d), ids, "user_id")


@BOOK.add("SELECT user_id, count(*) AS events, round(sum(value), 4) AS score FROM events GROUP BY user_id")
def event_dedup(spark, d):
    """Every third event is delivered twice; the second delivery, later and with another value, counts for nothing."""
    once = events(spark, d, "event_id", "user_id", "value").withColumn("delivery", F.lit(0))
    again = once.where(F.col("event_id") % 3 == 0).withColumn("delivery", F.lit(1)).withColumn("value", F.col("value") * 2)
    kept = L.first_deliveries(once.unionByName(again), "event_id", "delivery")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("score"))


_BUCKET = f"greatest(0, least(floor(score / {WIDTH}), {BUCKETS - 1}))::BIGINT"


@BOOK.add(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM ({BOARD}) GROUP BY 1")
def score_histogram(spark, d):
    return L.histogram(board(spark, d), WIDTH, BUCKETS)


_APPROX = f"""WITH b AS (SELECT *, {_BUCKET} AS bucket FROM ({BOARD})), h AS (SELECT bucket, count(*) AS n FROM b GROUP BY 1),
a AS (SELECT bucket, n, coalesce(sum(n) OVER (ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS higher, sum(n) OVER () AS total FROM h),
r AS (SELECT user_id, score, greatest(1, floor(higher + n * greatest(0.0, ((bucket + 1) * {WIDTH} - score) / {WIDTH}) + 0.5))::BIGINT AS approx, n AS own, total FROM b JOIN a USING (bucket))"""


@BOOK.add(f"{_APPROX} SELECT user_id, score, approx, own, round(approx / total * 100, 6) AS top_percent FROM r")
def approx_rank(spark, d):
    b = board(spark, d)
    return L.approx_rank(b, L.histogram(b, WIDTH, BUCKETS), "user_id", WIDTH, BUCKETS).withColumn("top_percent", F.round("top_percent", 6))


@BOOK.add(f"{_APPROX}, e AS (SELECT user_id, rank() OVER (ORDER BY score DESC) AS competition FROM ({BOARD})) SELECT count(*) AS members, max(abs(approx - competition))::BIGINT AS worst, bool_and(abs(approx - competition) <= own) AS within_bound FROM r JOIN e USING (user_id)")
def histogram_error(spark, d):
    """The approximate rank is off by the own bucket's population at most."""
    b = board(spark, d)
    exact = L.ranked(b, "user_id").select("user_id", "competition")
    both = L.approx_rank(b, L.histogram(b, WIDTH, BUCKETS), "user_id", WIDTH, BUCKETS).join(exact, "user_id")
    off = F.abs(F.col("approx") - F.col("competition"))
    return both.agg(F.count(F.lit(1)).alias("members"), F.max(off).alias("worst"), F.bool_and(off <= F.col("own")).alias("within_bound"))


_REGIONAL = f"SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY score DESC, o_custkey) - 1 AS position FROM ({BY_CUSTOMER})"


@BOOK.add(f"SELECT * FROM ({_REGIONAL}) WHERE position < 10")
def regional_boards(spark, d):
    return L.top_by(customers(spark, d), "o_custkey", "n_regionkey", 10)


@BOOK.add(f"SELECT o_custkey, score, row_number() OVER (ORDER BY score DESC, o_custkey) - 1 AS position, true AS in_global FROM (SELECT o_custkey, score FROM ({BY_CUSTOMER}) ORDER BY score DESC, o_custkey LIMIT 10)")
def regional_merge(spark, d):
    """The ten best of the regions' ten best are the ten best of all."""
    everyone = customers(spark, d)
    merged = L.ranked(L.top(L.top_by(everyone, "o_custkey", "n_regionkey", 10).drop("position"), "o_custkey", 10), "o_custkey").select("o_custkey", "score", "position")
    best = L.top(everyone, "o_custkey", 10).select("o_custkey", F.lit(True).alias("found"))
    return merged.join(best, "o_custkey", "left").select("o_custkey", "score", "position", F.coalesce("found", F.lit(False)).alias("in_global"))


@BOOK.add(f"SELECT greatest(0, least(floor(score / 50000.0), 39))::BIGINT AS bucket, count(*) AS n FROM ({BY_CUSTOMER}) GROUP BY 1")
def merged_histogram(spark, d):
    return L.merged(L.histograms(customers(spark, d), "n_regionkey", 50000.0, 40))


@BOOK.add("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, user_id, max(value) AS score FROM events GROUP BY 1, 2")
def weekly_board(spark, d):
    weekly = L.periods(events(spark, d, "ts", "user_id", "value"), "ts").groupBy("period", "user_id").agg(F.max("value").alias("score"))
    return weekly.select(F.date_format("period", "yyyy-MM-dd").alias("week"), "user_id", "score")


@BOOK.add("""WITH b AS (SELECT date_trunc('week', ts) AS period, user_id, sum(value) AS s FROM events GROUP BY 1, 2)
SELECT strftime(period, '%Y-%m-%d') AS week, count(*) AS members, round(max(s), 4) AS best FROM b WHERE period IN (SELECT DISTINCT period FROM b ORDER BY period DESC LIMIT 2) GROUP BY 1""")
def weekly_retention(spark, d):
    """Two weeks live; older boards have expired."""
    weekly = L.periods(events(spark, d, "ts", "user_id", "value"), "ts").groupBy("period", "user_id").agg(F.sum("value").alias("s"))
    return L.retained(weekly, 2).groupBy(F.date_format("period", "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("members"), F.round(F.max("s"), 4).alias("best"))


@BOOK.add("""SELECT strftime(day, '%Y-%m-%d') AS day, user_id, score, dense_rank() OVER (PARTITION BY day ORDER BY score DESC) AS dense
FROM (SELECT date_trunc('day', ts) AS day, user_id, floor(sum(value) / 20)::BIGINT AS score FROM events GROUP BY 1, 2)""")
def dense_snapshot(spark, d):
    return L.ranked(daily(spark, d), "user_id", ["period"]).select(F.date_format("period", "yyyy-MM-dd").alias("day"), "user_id", "score", "dense")


@BOOK.add("""SELECT strftime(day, '%Y-%m-%d') AS period, user_id, score, dense_rank() OVER (PARTITION BY day ORDER BY score DESC) AS dense
FROM (SELECT date_trunc('day', ts) AS day, user_id, floor(sum(value) / 20)::BIGINT AS score FROM events GROUP BY 1, 2)""")
def written_snapshot(spark, d):
    """The daily boards as they are read back from a written snapshot."""
    return L.snapshot(daily(spark, d), "user_id", f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}")


@BOOK.add(f"""WITH e AS (SELECT seq, floor(pow({sql_coin("player", "seq")}, 2.5) * 10000)::BIGINT AS player, 1 + floor({sql_coin("points", "seq")} * 50)::BIGINT AS points FROM (SELECT unnest(range(30000)) AS seq))
SELECT player, player % 3 AS region, sum(points)::BIGINT AS score, count(*) AS events FROM e GROUP BY player""")
def season_board(spark, d):
    from ..sources.traces import season

    return season(spark).groupBy("player", "region").agg(F.sum("points").alias("score"), F.count(F.lit(1)).alias("events"))


@BOOK.add(f"SELECT c_custkey, {sql_coin('shuffle', 'c_custkey')} AS coin FROM customer")
def coin_shuffle(spark, d):
    """All customers in a reproducible random order: by coin."""
    return table(spark, d, "customer", "c_custkey").select("c_custkey", coin("shuffle", F.col("c_custkey")).alias("coin")).orderBy("coin", "c_custkey")

"""Sorted sets as DataFrames (member, score): writes, lookups, ranks, histograms, merges.

One tie rule everywhere: score descending, then member ascending unless ``member_desc``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_deliveries(events: DataFrame, event_id: str, order: str) -> DataFrame:
    """Of deliveries with one event id the first by ``order``; the rest are retries."""
    rest = [c for c in events.columns if c != event_id]
    first = events.groupBy(event_id).agg(F.min_by(F.struct(*rest), F.col(order)).alias("first"))
    return first.select(event_id, "first.*")


def latest(events: DataFrame, member: str, score: str, seq: str) -> DataFrame:
    """Upsert: each member's last score."""
    return events.groupBy(member).agg(F.max_by(score, seq).alias("score"))


def changes(events: DataFrame, member: str, score: str, seq: str, greater: bool = False) -> DataFrame:
    """events with ``changed``: whether the upsert added the member or gave it another score; with ``greater`` only a greater one is taken."""
    before = W.partitionBy(member).orderBy(seq)
    if greater:
        held = F.max(score).over(before.rowsBetween(W.unboundedPreceding, -1))
        return events.withColumn("changed", held.isNull() | (F.col(score) > held))
    held = F.lag(score).over(before)
    return events.withColumn("changed", held.isNull() | (F.col(score) != held))


def best(events: DataFrame, member: str, score: str) -> DataFrame:
    """Keep-the-greater upsert: late or lower scores change nothing, so the order of events doesn't matter."""
    return events.groupBy(member).agg(F.max(score).alias("score"))


def total(events: DataFrame, member: str, delta: Column) -> DataFrame:
    return events.groupBy(member).agg(F.sum(delta).alias("score"))


def floored_totals(events: DataFrame, by: list[str], delta: str, seq: str, width: float) -> DataFrame:
    """(by, score): how many whole widths each group's deltas (doubles) come to, added in the order of ``seq``.

    A sum of doubles depends on the order in its last places, so at a multiple of width partial sums would give now one score, now the
    other. They stand where no order comes to another score; only groups nearer to a multiple are added in order, as sorted streams.
    """
    score = lambda total: F.floor(total / width)
    fast = events.groupBy(*by).agg(F.sum(delta).alias("_sum"), F.sum(F.abs(delta)).alias("_size"), F.count(delta).alias("_n"))
    off = F.col("_n") * F.col("_size") * 2.0**-51  # twice what two orders of n additions can differ by
    near = fast.where(~score(F.col("_sum") - off).eqNullSafe(score(F.col("_sum") + off))).select(*[F.col(c).alias(f"_{c}") for c in by])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    upto = W.partitionBy(*by).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    added = events.join(near, same, "left_semi").withColumn("_upto", F.sum(delta).over(upto))
    exact = added.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max_by("_upto", seq).alias("_total"))
    return fast.join(exact, same, "left").select(*by, score(F.coalesce("_total", "_sum")).alias("score"))


def _by_rank(member: str, member_desc: bool) -> list[Column]:
    return [F.col("score").desc(), F.col(member).desc() if member_desc else F.col(member).asc()]


def top(board: DataFrame, member: str, k: int, member_desc: bool = False) -> DataFrame:
    return board.orderBy(*_by_rank(member, member_desc)).limit(k)


#: Members that one task orders, and ranges at most.
TASK, RANGES = 1 << 20, 4096
#: Files of a period in a snapshot, at most.
PARTS = 16


def _ranges(board: DataFrame) -> DataFrame:
    """board with ``_range``: like scores share one, higher scores have lower numbers, null the highest. Bounds are quantiles, RANGES at most."""
    want = min(RANGES, max(8, board.count() // TASK))
    score = F.col("score").cast("double")
    bounds = sorted(set(board.select(score.alias("score")).approxQuantile("score", [k / want for k in range(1, want)], 1 / (4 * want))))
    beyond = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<double>"), lambda b: b > score))
    return board.withColumn("_range", F.when(score.isNull(), len(bounds) + 1).otherwise(beyond))


def ranked(board: DataFrame, member: str, by: list[str] | None = None, member_desc: bool = False) -> DataFrame:
    """position (0-based), competition rank ("1224") and dense rank ("1223"), within ``by`` or over all.

    Over all members the board is cut into ranges of scores, each is ordered by a task of its own, and what stands in
    the ranges above is added.
    """
    part = W.partitionBy(*(by or ["_range"]))
    score = part.orderBy(F.col("score").desc())
    within = {
        "position": F.row_number().over(part.orderBy(*_by_rank(member, member_desc))) - 1,
        "competition": F.rank().over(score),
        "dense": F.dense_rank().over(score),
    }
    if by:
        return board.select("*", *[x.cast("bigint").alias(c) for c, x in within.items()])
    cut = _ranges(board)
    # One row for each range, so RANGES at most come to the driver. As a join with itself this would meet a constraint that
    # Catalyst infers through the lambda of _range, for the wrong side.
    counted = {r["_range"]: r for r in cut.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("score").alias("d")).collect()}
    above: dict[str, list[int]] = {"n": [0], "d": [0]}
    for i in range(max(counted, default=0)):
        for c, sums in above.items():
            sums.append(sums[-1] + (counted[i][c] if i in counted else 0))
    more = {c: F.element_at(F.lit(sums).cast("array<bigint>"), F.col("_range") + 1) for c, sums in above.items()}
    placed = cut.select("*", *[x.alias(c) for c, x in within.items()])
    plus = {"position": "n", "competition": "n", "dense": "d"}
    return placed.select(*board.columns, *[(F.col(c) + more[x]).cast("bigint").alias(c) for c, x in plus.items()])


def rank_by_counts(board: DataFrame, member: str) -> DataFrame:
    """Competition and dense rank by way of the distinct scores: members are counted per score first, and only the
    (score, count) rows are ordered. For boards with far fewer scores than members. Members without a score come last."""
    counts = board.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy(F.col("score").desc())
    above = counts.select(F.col("score").alias("_score"), (F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("competition"), F.row_number().over(order).cast("bigint").alias("dense"))
    return board.join(above, F.col("score").eqNullSafe(F.col("_score"))).select(member, "score", "competition", "dense")


def page(board: DataFrame, member: str, first: int, last: int) -> DataFrame:
    """Members at positions first to last, both included, from the top: the best last + 1 are found in parallel, then numbered."""
    found = top(board, member, last + 1)
    return ranked(found, member).where(F.col("position") >= first).select(member, "score", "position")


def count_above(board: DataFrame, score: float) -> DataFrame:
    return board.where(F.col("score") > score).agg(F.count(F.lit(1)).alias("n"))


def lookup(board: DataFrame, ids: DataFrame, member: str) -> DataFrame:
    """Scores of the ids asked for; null for a member that isn't on the board."""
    return ids.join(board, member, "left").select(member, "score")


def composite(points: Column, minute: Column, bits: int = 22) -> Column:
    """One number that orders by points, then by who came first: points in the high bits, the time left below."""
    return F.shiftleft(points.cast("bigint"), bits) + (F.lit((1 << bits) - 1) - minute.cast("bigint"))


def composite_points(code: Column, bits: int = 22) -> Column:
    return F.shiftright(code, bits)


def composite_minute(code: Column, bits: int = 22) -> Column:
    return F.lit((1 << bits) - 1) - code.bitwiseAND(F.lit((1 << bits) - 1))


def friends(board: DataFrame, ids: DataFrame, member: str) -> DataFrame:
    """The ids among themselves; who isn't on the board has 0."""
    return ranked(lookup(board, ids, member).withColumn("score", F.coalesce("score", F.lit(0).cast(board.schema["score"].dataType))), member).select(member, "score", "position")


def histogram(board: DataFrame, width: float, buckets: int) -> DataFrame:
    """Members per score bucket, the last open upwards."""
    return board.groupBy(bucket_of(F.col("score"), width, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bucket_of(score: Column, width: float, buckets: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(score / F.lit(width)), F.lit(buckets - 1))).cast("bigint")


def histograms(board: DataFrame, by: str, width: float, buckets: int) -> DataFrame:
    """(by, bucket, n): the histograms of all regions in one pass."""
    return board.groupBy(by, bucket_of(F.col("score"), width, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(*histograms: DataFrame) -> DataFrame:
    """Histograms of disjoint boards as one: counts add."""
    whole = histograms[0]
    for h in histograms[1:]:
        whole = whole.unionByName(h)
    return whole.groupBy("bucket").agg(F.sum("n").alias("n"))


def approx_rank(board: DataFrame, counts: DataFrame, member: str, width: float, buckets: int) -> DataFrame:
    """Rank from the histogram: all in higher buckets, plus the own bucket's share above the score, from 1 on; and the
    top percentage. ``own`` is the bucket's population, which bounds the error. Only bucket rows are ordered."""
    above = counts.select("bucket", "n", F.coalesce(F.sum("n").over(W.orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("higher"), F.sum("n").over(W.partitionBy()).alias("total"))
    share = ((F.col("bucket") + 1) * F.lit(float(width)) - F.col("score")) / F.lit(float(width))
    rank = F.greatest(F.lit(1), F.floor(F.col("higher") + F.col("n") * F.greatest(F.lit(0.0), share) + 0.5)).cast("bigint")
    at = board.withColumn("bucket", bucket_of(F.col("score"), width, buckets)).join(F.broadcast(above), "bucket")
    return at.select(member, "score", rank.alias("approx"), F.col("n").alias("own"), (rank / F.col("total") * 100).alias("top_percent"))


def top_by(board: DataFrame, member: str, region: str, k: int) -> DataFrame:
    """The best k of each region."""
    order = W.partitionBy(region).orderBy(*_by_rank(member, False))
    return board.withColumn("position", F.row_number().over(order).cast("bigint") - 1).where(F.col("position") < k)


def periods(events: DataFrame, ts: str, unit: str = "week") -> DataFrame:
    """events with the period they fall in; a new period starts with an empty board of its own."""
    return events.withColumn("period", F.date_trunc(unit, F.col(ts)))


def retained(boards: DataFrame, keep: int) -> DataFrame:
    """Boards of the last ``keep`` periods; older ones have expired. Periods are few and are ordered alone."""
    live = boards.select("period").distinct().orderBy(F.col("period").desc()).limit(keep)
    return boards.join(F.broadcast(live), "period", "left_semi")


def snapshot(boards: DataFrame, member: str, path: str) -> DataFrame:
    """Write each period's board with dense ranks as Parquet below ``path``, a folder for each period, and read it back.

    A period that is written again replaces its folder; the folders of other periods stay as they are.
    """
    made = ranked(boards, member, ["period"]).select(F.date_format("period", "yyyy-MM-dd").alias("period"), member, "score", "dense")
    writer = made.repartition("period", F.pmod(F.xxhash64(member), F.lit(PARTS))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period").parquet(path)
    return made.sparkSession.read.schema(made.schema).option("basePath", path).parquet(path).select(*made.columns)

"""Where keys live: modulo placement and consistent-hash rings with virtual points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import hash32

SPACE = 1 << 32


def modulo(key: Column, nodes: int) -> Column:
    return F.pmod(hash32(key), F.lit(nodes))


def ring(nodes: DataFrame, points: int = 100) -> DataFrame:
    """(node, hash): each node's virtual points, at the hashes of node#0, node#1, ..."""
    numbered = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("v"))
    return numbered.select("node", hash32(F.concat_ws("#", "node", F.col("v").cast("string"))).alias("hash"))


def without(points: DataFrame, node: str) -> DataFrame:
    """The ring after a node left: its points go, no others move."""
    return points.where(F.col("node") != node)


def intervals(points: DataFrame) -> DataFrame:
    """(lo, hi, node): a node owns the hashes above the point before and up to its own; the first also those beyond the last.

    Points with one hash belong to the node that comes first by name. A ring has some thousands of points; ordering
    them is one small task.
    """
    one = points.groupBy("hash").agg(F.min("node").alias("node"))
    order, everything = W.orderBy("hash"), W.partitionBy()
    cut = one.select(F.lag("hash", 1, -1).over(order).alias("lo"), F.col("hash").alias("hi"), "node", F.max("hash").over(everything).alias("last"), F.min("hash").over(everything).alias("first"))
    wrap = cut.where(F.col("hi") == F.col("first")).select(F.col("last").alias("lo"), F.lit(SPACE - 1).cast("bigint").alias("hi"), "node")
    return cut.select("lo", "hi", "node").unionByName(wrap)


def owners(keys: DataFrame, key: str, points: DataFrame, cells: int = 1024) -> DataFrame:
    """keys with ``node``: the owner of the first point at the key's hash or after it.

    An equi-join, not a range join: hash space is cut into ``cells`` equal cells, intervals are listed in the cells they
    touch (at most points + cells rows), and keys look only into their own.
    """
    size = SPACE // cells
    cut = intervals(points).select("lo", "hi", "node", F.explode(F.sequence(F.floor(F.greatest(F.col("lo"), F.lit(0)) / size), F.floor(F.col("hi") / size))).alias("_cell"))
    hashed = keys.withColumn("_h", hash32(F.col(key).cast("string"))).withColumn("_cell", F.floor(F.col("_h") / size))
    return hashed.join(F.broadcast(cut), "_cell").where((F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi"))).drop("_cell", "lo", "hi").withColumnRenamed("_h", "hash")


def moved(both: DataFrame) -> DataFrame:
    """How many keys changed their owner, of rows with ``was`` and ``node``: (keys, moved, fraction); the fraction of none is 0."""
    changed, keys = F.count_if(F.col("was") != F.col("node")), F.count(F.lit(1))
    return both.agg(keys.alias("keys"), changed.alias("moved"), F.coalesce(F.try_divide(changed, keys), F.lit(0.0)).alias("fraction"))


def remapped(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """moved() of two placements (key, node) that come from different tables."""
    return moved(before.select(key, F.col("node").alias("was")).join(after.select(key, "node"), key))


def ring_remapped(keys: DataFrame, key: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """moved() of a ring's points before and after a change: keys pass both rings on their way, none is shuffled."""
    was = owners(keys.select(key), key, before).select(key, F.col("node").alias("was"))
    return moved(owners(was, key, after))

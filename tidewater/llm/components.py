"""Connected components of links, by contraction.

In each round every vertex points to its smallest neighbour (or itself), pointers are followed once more, and
edges are drawn anew between what was pointed to. At least half of the vertices that still have edges go in a
round. Nothing is collected but the number of edges left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stored


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (v, label) with labels merged along links (a, b) between labels. If it is a stored table, it is removed when a new
    one takes its place. Keys may be of any type that can be ordered."""
    edges = stored(links.where("a != b").distinct(), "links")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("p"))
        least = stored(least, "pointers")
        onward = least.select(F.col("x").alias("p"), F.col("p").alias("q"))
        to = stored(least.join(onward, "p").select("x", F.col("q").alias("y")), "pointers")
        merged = labels.join(to, F.col("label") == F.col("x"), "left").select("v", F.coalesce("y", "label").alias("label"))
        one = edges.join(to, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        left = one.join(to, F.col("b") == F.col("x")).select("a", F.col("y").alias("b")).where("a != b").distinct()
        done = (labels, edges, least, to)
        labels, edges = stored(merged, "labels"), stored(left, "links")
        discard(*done)
    discard(edges)
    return labels

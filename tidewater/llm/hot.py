"""A join on texts of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import fresh, of, quoted

#: A text with more than 1 / SHARE of all rows (and SOME at least) is hot; there are less than SHARE of them.
SHARE, SOME = 1000, 64


def with_rows(df: DataFrame, text: str, out: str, judged: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """df, of ``rows`` rows and without column ``out``, as ``d`` joined with ``judged`` (k1, k2, ...), one row for each text, as ``j``.

    Rows of a hot text are dealt to
    several tasks by their place in the input, and judged has its row in each of them. The list of hot texts is bounded
    by SHARE and broadcast.
    """
    had = [c for c in df.columns if c.lower() != out.lower()]
    k1, k2, turn = fresh(df, "_k1"), fresh(df, "_k2"), fresh(df, "_turn")
    body = F.coalesce(quoted(text), F.lit(""))
    keyed = df.select(*[quoted(c) for c in had], F.xxhash64(body, F.lit(1)).alias(k1), F.xxhash64(F.lit(2), body).alias(k2))
    limit = max(SOME, rows // SHARE)
    counts = keyed.groupBy(F.col(k1).alias("h1"), F.col(k2).alias("h2")).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(counts.where(F.col("n") > limit).select("h1", "h2", F.ceil(F.col("n") / limit).alias("parts"))).alias("hot")
    same = lambda a, b: (a == F.col("hot.h1")) & (b == F.col("hot.h2"))
    parts = F.coalesce(F.col("hot.parts"), F.lit(1))
    found = keyed.alias("r").join(hot, same(of("r", k1), of("r", k2)), "left")
    dealt = F.pmod(F.monotonically_increasing_id(), parts).cast("long").alias(turn)
    d = found.select(*[of("r", c).alias(c) for c in had], dealt, of("r", k1).alias(k1), of("r", k2).alias(k2)).alias("d")
    each = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_turn")
    j = judged.alias("r").join(hot, same(F.col("r.k1"), F.col("r.k2")), "left").select(*[of("r", c).alias(c) for c in judged.columns], each).alias("j")
    return d.join(j, (of("d", k1) == F.col("j.k1")) & (of("d", k2) == F.col("j.k2")) & (of("d", turn) == F.col("j._turn")), how)

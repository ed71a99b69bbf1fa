"""Two-pass external shuffle: scatter rows into memory-sized buckets, then shuffle each bucket and write it.

Pass one sends each row to a bucket by a seeded hash, so every bucket is a uniform draw of all rows and
fits in memory. Pass two brings each bucket into one order and shuffles it (the built-in ``shuffle``, which is
Fisher-Yates from a seed). The buckets laid end to end are one random order of all rows, and the shards
are equal runs of it: their row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .columns import quoted
from .store import stored

#: A bucket with more than HEAVY times the mean (and LEAST more) holds rows of one id, which are dealt anew by their place in the input.
HEAVY, LEAST = 4, 64
#: Neighbouring buckets that share a task of pass two.
TOGETHER = 8


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, T.MapType | T.VariantType)


def _by_hash(a: Column, b: Column) -> Column:
    """For rows that have no natural order since they hold maps."""
    smaller = (a["h"] < b["h"]) | ((a["h"] == b["h"]) & (a["g"] < b["g"]))
    return F.when(smaller, -1).when((a["h"] == b["h"]) & (a["g"] == b["g"]), 0).otherwise(1)


def shard(df: DataFrame, shards: int, seed: int = 0, id_column: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20, min_buckets: int = 256) -> DataFrame:
    """df with int ``shard`` (0 to shards - 1) and long ``slot`` (0, 1, ... in each shard), in a random order.

    The order depends on the rows, ``seed`` and the two bucket parameters only: rows alike in id and text are told apart by
    their other columns, and rows alike in all are interchangeable. Buckets are as many as keep each near
    ``bucket_bytes`` (text and id), and ``min_buckets`` at least; a few share a task, one after the other. Where so many
    rows repeat an id that its bucket grows beyond HEAVY times the mean, that bucket's rows are dealt to all buckets by their
    place in the input; only then the order depends on how the input is partitioned. Rows with a null id are
    dealt by their text. Repeated rows each get a place of their own. With fewer rows than shards the last shards stay
    empty; an empty table gives an empty one. A very long text is one row of one bucket and is never cut. Columns
    called ``shard`` or ``slot`` are replaced; all others come back as they are.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    had = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    id_, body = quoted(id_column), quoted(text)
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.coalesce(F.octet_length(body), F.lit(0)) + 16), F.lit(0)).alias("bytes")).first()
    rows, buckets = int(total["rows"]), max(min_buckets, -(-int(total["bytes"]) // bucket_bytes))
    by = F.pmod(F.when(id_.isNull(), F.xxhash64(body, F.lit(seed))).otherwise(F.xxhash64(id_, F.lit(seed))), F.lit(buckets))
    other = F.xxhash64(*[quoted(c) for c in had if _hashable(df.schema[c].dataType)])
    row = F.struct(*[quoted(c) for c in had]).alias("row")
    keyed = df.select(by.alias("bucket"), F.xxhash64(id_, body, F.lit(seed), F.lit("order")).alias("h"), other.alias("g"), row)
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    heavy = counts.where(F.col("n") > HEAVY * rows // buckets + LEAST).select("bucket")
    if heavy.limit(1).count():  # at most a quarter of all buckets
        anew = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(buckets))
        # Written, since these rows are read more than once and their places must not change between.
        dealt = stored(keyed.join(F.broadcast(heavy), "bucket").select(anew.alias("bucket"), "h", "g", "row"), "heavy-buckets")
        keyed = keyed.join(F.broadcast(heavy), "bucket", "left_anti").unionByName(dealt)
        counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    packed = keyed.withColumn("task", (F.col("bucket") / TOGETHER).cast("int")).repartitionById(-(-buckets // TOGETHER), "task")
    lists = packed.groupBy("task", "bucket").agg(F.collect_list(F.struct("h", "g", "row")).alias("rows"))
    steady = F.sort_array("rows") if _hashable(keyed.schema["row"].dataType) else F.array_sort("rows", _by_hash)
    # The seed runs on from bucket to bucket of a partition, so these are in order.
    shuffled = lists.withColumn("rows", steady).sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = shuffled.join(F.broadcast(offsets), "bucket").select("offset", F.posexplode("rows").alias("p", "r")).select(F.col("r.row").alias("row"), (F.col("offset") + F.col("p")).alias("at"))
    few, extra = divmod(rows, shards)  # the first ``extra`` shards get few + 1 rows
    at, head = F.col("at"), extra * (few + 1)
    place = F.when(at < head, F.floor(at / (few + 1))).otherwise(extra + F.floor((at - head) / max(few, 1))).cast("int")
    first = F.when(at < head, place * F.lit(few + 1)).otherwise(F.lit(head) + (place - extra) * F.lit(few))
    return placed.select(*[F.col("row")[c].alias(c) for c in had], place.alias("shard"), (at - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """shard() written as Parquet under path/shard=K, in the order of slots within each file: each bucket's task writes its own run, with no further shuffle."""
    shard(df, shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 16).cast("long").alias("size")
    return shard(docs, 40, seed=11).select("doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

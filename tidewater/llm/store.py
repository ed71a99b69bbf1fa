"""Written tables between jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder takes its place in local mode, as in tests;
    on a cluster that is an error, since executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Spark's setting by which a finished job's shuffle files are removed at its end, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of an Arrow batch, where the session says nothing: rows are whole documents, of which Spark's 10,000 are too many to be held
#: by a task as a batch, on both sides of the pipe to Python.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session send documents to Python in batches of ROWS, unless it has a setting of its own. Results don't depend on it."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df computed once, written under spark.checkpoint.dir and read again: a later loss of executors costs nothing of it. The
    shuffle files of the job that writes it go with its end: what follows reads the table."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing will read again; other tables are left alone."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__.get("_stored_at")
        if path is None:
            continue
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

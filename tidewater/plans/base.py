"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, with only the columns that are read."""
    found = spark.read.parquet(f"{d}/{name}.parquet")
    return found.select(*columns) if columns else found


class Book:
    """Queries by name, each with its SQL if there is one."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep

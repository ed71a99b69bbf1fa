"""Name to query and name to SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boards, caches, streams, systems, traffic

BOOKS = (boards.BOOK, traffic.BOOK, caches.BOOK, systems.BOOK, streams.BOOK)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for book in BOOKS for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}

"""Every query that has SQL gives the same rows, names and types as an independent engine."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidewater.plans import catalog

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for f in os.listdir(tables):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tables}/{f}'")
    return c


def plain(value):
    return round(value, 9) if isinstance(value, float) else str(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, tables, name):
    df, sql = catalog.queries()[name](spark, tables), duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    kinds = dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert {c: KINDS.get(k, kinds[c]) for c, k in df.dtypes} == kinds
    rows = lambda all_: sorted((tuple(map(plain, r)) for r in all_), key=repr)
    assert rows(df.select(*columns).collect()) == rows(sql.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, tables, name):
    assert catalog.queries()[name](spark, tables).count() > 0

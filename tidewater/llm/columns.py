"""Small helpers on columns and names that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of df has it (case does not count)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def of(alias: str, name: str) -> Column:
    """Column ``name`` of the table called ``alias``."""
    return F.col(alias + ".`" + name.replace("`", "``") + "`")


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with column ``name`` set; columns of that name, in any case, are replaced."""
    return df.select(*[quoted(c) for c in df.columns if c.lower() != name.lower()], value.alias(name))


def row_key(id_column: str | None, text_column: str) -> Column:
    """What tells documents apart: two 64-bit hashes, of the id and of the whole text. Rows alike in both are one document listed again."""
    text = quoted(text_column)
    first = F.xxhash64(quoted(id_column)) if id_column else F.xxhash64(F.reverse(text))
    return F.struct(first.alias("i"), F.xxhash64(text, F.lit(7)).alias("t"))

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plain import corpus  # noqa: E402

#: Names that operators use inside or give to results: columns of the input may have them too.
CLASHES = "`k1` int, `mix` string, `Shard` string, slot int, `quality` double, `text2` string, `a.b` string, bucket int, n int, id string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


@pytest.fixture(scope="session")
def docs(spark):
    texts = corpus()
    rows = [(i, t, "en", [None, "src0", "src1", "src0", "é"][i % 5], None, i, "m", "s", 1, 0.5, "t", "ab", 2, 3, "id") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def plain_rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None) + sorted((r["doc_id"], None) for r in docs.collect() if r["text"] is None)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null texts, rows that repeat, null everything."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, None, None), (None, text, None, None), (7, text, "en", "s"), (7, text, "en", "s"), (7, text + " more", "en", "s"), (8, None, None, None), (None, None, None, None), (9, "", "", "")]
    return spark.createDataFrame([(*r, None, *[None] * 10) for r in rows], SCHEMA).repartition(2)

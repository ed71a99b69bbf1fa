"""The automaton against the contract written out plainly, on random words and in several groups."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from plain import contamination as plainly
from pyspark.sql import functions as F

from tidewater.llm import decontam


@pytest.mark.parametrize("seed", range(3))
def test_automaton(seed):
    rng = random.Random(seed)
    for _ in range(120):
        letters = rng.choice(["ab", "abc", "abcdef"])
        line = lambda n, letters=letters: " ".join(rng.choice(letters) for _ in range(n))
        items = [(str(i), line(rng.randint(0, 9))) for i in range(rng.randint(0, 6))]
        width = rng.randint(1, 5)
        a = decontam.Automaton.build(items, width)
        texts = [line(rng.randint(0, 30)) for _ in range(5)] + [None, ""]
        for text, got in zip(texts, decontam.scan(pa.array(texts, pa.string()), a).to_pylist(), strict=True):
            assert (got["n_words"], got["n_hit"], got["items"]) == plainly(text, items, width), (items, width, text)


def test_groups_agree_with_one(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    items = [(i, line(rng.randint(0, 40))) for i in range(30)] + [(None, "a b c"), (40, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, line(rng.randint(0, 120)), i) for i in range(60)] + [(60, None, 1), (61, "", 2), (61, "", 2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, contamination int").repartition(3)
    rows = lambda df: sorted(map(str, df.select("doc_id", "text", F.to_json("contamination")).collect()))
    one = rows(decontam.contamination(docs, benchmark, width=3))
    assert rows(decontam.contamination(docs, benchmark, width=3, max_bytes=100)) == one
    named = [("null" if i is None else str(i), t) for i, t in items]
    for r in decontam.contamination(docs, benchmark, width=3, max_bytes=200).collect():
        got = r["contamination"]
        assert (got["n_words"], got["n_hit"], got["items"]) == plainly(r["text"], named, 3)


def test_memory_of_the_automaton():
    """Flat arrays: not more than 100 bytes a word of the items."""
    rng = random.Random(4)
    items = [(str(i), " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for i in range(200)]
    a = decontam.Automaton.build(items)
    arrays = (a.first, a.words, a.to, a.up, a.size, a.base, a.hop, a.own_first, a.owned, a.pairs, a.singles)
    assert sum(x.nbytes for x in arrays) < 100 * 200 * 200

"""Each registered query over the given tables, against SQL where there is some, else against the contract written out plainly."""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

import duckdb
import plain
import pytest
from plain import sha

from tidewater.llm import catalog, pii, quality, urls


@pytest.fixture(scope="module")
def documents(spark, tables):
    return [r.asDict() for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def ran(spark, tables, name):
    return [r.asDict() for r in catalog.queries()[name](spark, tables).collect()]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, tables, name):
    con = duckdb.connect()
    for f in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = ran(spark, tables, name)
    assert sorted(columns) == sorted(got[0])
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want.fetchall())


def test_every_query_is_here():
    held = {"op1_sharding", "op2_url_filter", "op3_suffixes", "op4_mixing", "op6_quality", "op10_pii"}  # op1 in test_sharding_plain.py
    assert held | set(catalog.oracle_sql()) == set(catalog.queries())


def rule_of(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_op2(spark, tables):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{tables}/pages.parquet").select("page_id", "url").collect()}
    made = ran(spark, tables, "op2_url_filter")
    assert sorted(r["page_id"] for r in made) == sorted(pages)
    scored = []
    for r in made:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r["page_id"]] or "")
        host, path = (m[1].translate(plain.LOWER), m[2]) if m else ("", "")
        rule = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] in ("allow", "block") and (rule is None or (r["verdict"] == "allow") == rule.allow)
        assert (r["score"] is None) == (rule is not None)
        if rule is None:
            scored.append((r["score"], r["verdict"]))
    allowed, blocked = [s for s, v in scored if v == "allow"], [s for s, v in scored if v == "block"]
    assert not allowed or not blocked or min(allowed) > max(blocked)


def test_op2_models_plainly(spark):
    """Scores from models counted and smoothed here, a character at a time."""
    import random

    rng = random.Random(8)
    texts = [("".join(rng.choice("abc/") for _ in range(rng.randint(0, 7))), bool(rng.randrange(2)), rng.randint(1, 3)) for _ in range(60)]
    counts = [defaultdict(float), defaultdict(float)]
    for u, accepted, n in texts:
        padded = urls.START * urls.ORDER + u + urls.END
        for i in range(urls.ORDER, len(padded)):
            for k in range(urls.ORDER + 1):
                counts[not accepted][padded[i - k : i + 1]] += n
    contexts = [defaultdict(float), defaultdict(float)]
    for c, totals in zip(counts, contexts, strict=True):
        for gram, n in c.items():
            totals[gram[:-1], len(gram)] += n

    def chance(m, gram):
        if len(gram) == 1 and not counts[0][gram] and not counts[1][gram]:
            return urls.BASE  # a character that neither model knows says nothing
        below = chance(m, gram[1:]) if len(gram) > 1 else urls.BASE
        return (counts[m][gram] + urls.WEIGHT * below) / (contexts[m][gram[:-1], len(gram)] + urls.WEIGHT)

    import math

    asked = sorted({u for u, _, _ in texts} | {"zzz", "abcabc", ""})
    model = urls.fit(spark.createDataFrame([(u, n, a) for u, a, n in texts], "u string, n long, accepted boolean"))
    got = {r["u"]: r["score"] for r in urls.score(spark.createDataFrame([(u,) for u in asked], "u string"), model).collect()}
    for u in asked:
        padded = urls.START * urls.ORDER + u + urls.END
        total = 0.0
        for i in range(urls.ORDER, len(padded)):
            gram = padded[i - urls.ORDER : i + 1]
            total += math.log(chance(0, gram) / chance(1, gram))
        assert got[u] == pytest.approx(total / (len(u) + 1), abs=1e-6), u


def test_op3(spark, tables, documents):
    want = {k: row for k, *row in plain.repeated_bytes([(d["doc_id"], d["text"]) for d in documents], 200)}
    for r in ran(spark, tables, "op3_suffixes"):
        assert [r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]] == want.pop(r["doc_id"])
    assert not want


def filled(sizes, weights, most):
    """Targets by pouring: sources at their cap leave, the others share the rest by weight."""
    left, open_, got = float(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > most * sizes[k]]
        if not over:
            return got | share
        for k in over:
            got[k] = float(most * sizes[k])
            left -= got[k]
            open_.remove(k)
    return got


def test_op4(spark, tables, documents):
    size = {d["doc_id"]: len(plain.words(d["text"])) for d in documents}
    names = sorted({d["source"] for d in documents if d["source"] is not None}) + [None] * any(d["source"] is None for d in documents)
    total = {n: sum(size[d["doc_id"]] for d in documents if d["source"] == n) for n in names}
    target = filled([total[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    source, made = {d["doc_id"]: d["source"] for d in documents}, ran(spark, tables, "op4_mixing")
    assert sorted(r["doc_id"] for r in made) == sorted(size)
    taken = defaultdict(int)
    for r in made:
        n = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[n])
        assert r["target"] == pytest.approx(target[names.index(n)])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[n] += r["taken"]
    for k, n in enumerate(names):
        assert abs(taken[n] - target[k]) <= max(s for d, s in size.items() if source[d] == n)
    assert sorted(map(str, made)) == sorted(map(str, ran(spark, tables, "op4_mixing")))


def test_op6(spark, tables, documents):
    import zstandard

    rules, squeeze = quality.Rules(), zstandard.ZstdCompressor(level=3).compress
    texts = {d["doc_id"]: d["text"] for d in documents}

    def band(n):
        return [b for b in rules.bands if b[0] <= n][-1][1:]

    def keeps(raw):
        ratio = lambda x: len(squeeze(x)) / len(x)
        low, high = band(len(raw))
        if not low <= ratio(raw) <= high:
            return False
        pieces, odd = [raw[i : i + 4096] for i in range(0, len(raw), 4096)], 0
        for p in pieces:
            lo, hi = (rules.low, rules.high) if len(p) == 4096 else (band(len(p))[0] * 0.75, band(len(p))[1] * 1.25)
            odd += not lo <= ratio(p) <= hi
        return 100 * odd <= 34 * len(pieces)

    for r in ran(spark, tables, "op6_quality"):
        text = texts.pop(r["doc_id"])
        *counts, failed = plain.base_quality(text)
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == counts and r["base_failed"] == failed
        assert r["kept"] == (not failed and keeps(text.encode()))
    assert not texts


def test_op10(spark, tables, documents):
    texts = {d["doc_id"]: d["text"] for d in documents}
    for r in ran(spark, tables, "op10_pii"):
        text = texts.pop(r["doc_id"])
        base = plain.base_pii(text)
        assert r["base_sha256"] == sha(",".join(base))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k + ":") for x in base) for k in ("email", "ip", "card", "phone")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[: len(base)] == base and r["n_spans"] == len(spans)
        assert spans == [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.find(text)]
    assert not texts


def test_probe_offsets():
    """Windows at offsets 0 to 5 of a block of ten meet every pair: for all offsets of two equal runs of twenty words one holds a
    whole block where the other has a probed window."""
    length, window = 10, 20
    for a in range(length):
        for b in range(length):
            places = range(window - length + 1)
            assert any(((a + p) % length == 0 and (b + p) % length <= 5) or ((b + p) % length == 0 and (a + p) % length <= 5) for p in places), (a, b)

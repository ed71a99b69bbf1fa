"""Each operator against its contract written out plainly, and over nulls, repeats, empty tables and clashing names."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest
from plain import corpus
from pyspark.sql import functions as F

from tidewater.llm import components, decontam, jaccard, kernels, licences, mixing, pii, quality, sharding, substrings, suffixes, urls
from tidewater.llm.licence_texts import TEXTS

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it sleeps all day"), (2, "short Item, here"), (3, "one"), (4, None), (5, "..."), (None, "a b c"), (10, "over the lazy dog and then it sleeps all day long")]
BENCHMARK = "item_id long, text string"


def same_columns(before, after, *added):
    """All columns of before, as they were, and the added ones."""
    return set(after.columns) == ({c for c in before.columns if c.lower() not in {a.lower() for a in added}} | set(added))


# sharding


@pytest.mark.parametrize("shards", [7, 500])
def test_shards_are_even_and_gapless(spark, docs, shards):
    made = sharding.shard(docs, shards, seed=3, min_buckets=16)
    assert same_columns(docs, made, "shard", "slot")
    by = defaultdict(list)
    for r in made.select("doc_id", "shard", "slot").collect():
        by[r["shard"]].append(r["slot"])
    n = docs.count()
    assert sum(map(len, by.values())) == n and all(0 <= s < shards for s in by)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard(docs.repartition(2), shards, seed=3, min_buckets=16)
    place = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.select("doc_id", "shard", "slot").collect())
    assert place(made) == place(again)
    assert place(made) != place(sharding.shard(docs, shards, seed=4, min_buckets=16)) or shards > n


def test_shards_are_shuffled(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    order = [r["doc_id"] for r in sharding.shard(many, 1, seed=1, min_buckets=8).orderBy("slot").collect()]
    up = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert sorted(order) == list(range(4000)) and 1850 < up < 2150


def test_shards_on_disk(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 5, min_buckets=8)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 5


def test_shards_of_odd_rows(empty, odd):
    assert sharding.shard(empty, 3).count() == 0
    assert sorted(r["slot"] for r in sharding.shard(odd, 1, min_buckets=4).collect()) == list(range(8))


# URL filter

URLS = ["http://A.example.org/en/1x", "https://example.org/es/", "http://example.org/en/2", "http://notexample.org", "http://x.com/de/1?q", "ftp://x.com/fr/", "x.com/fr/", None, "", "http://x.com", "http://x.net/a#b", "http://É.net/É", "://", "http://x.net/\nq", "http://y.net:80/p://q"]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    u = F.col("url")
    got = df.select("page_id", urls.host(u), urls.path(u), urls.ruled(urls.host(u), urls.path(u), urls.RULES)["rule"]).collect()
    for (i, h, p, r), url in zip(sorted(got), URLS, strict=True):
        head, sep, rest = (url or "").partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(plain.LOWER) if sep else ""
        path = rest[cut:] if sep else ""
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [x for x in urls.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        assert (h, p, r) == (host, path, max(fits, key=lambda x: len(x.name)).name if fits else None)


def test_url_models_learn(spark):
    rng = random.Random(5)
    good = ["http://%s.org/en/%s" % (rng.choice(["river", "stone", "meadow"]), rng.choice(["garden", "kitchen", "forest"]) + str(i)) for i in range(300)]
    bad = ["http://%s.com/de/%s" % (rng.choice(["zzq", "xxv", "qkz"]), rng.choice(["wqzx", "xzvq"]) + str(i)) for i in range(300)]
    ask = [(True, "http://river.net/en/garden%d" % i) for i in range(30)] + [(False, "http://zzq.net/en/xzvq%d" % i) for i in range(30)]
    df = spark.createDataFrame([(u, None) for u in good + bad] + [(u, ok) for ok, u in ask] + [(None, None)], "url string, ok boolean")
    made = urls.url_filter(df, urls.RULES)
    judged = made.where("ok is not null").select("ok", "url_filter.allow", "url_filter.score").collect()
    assert sum(r["ok"] == r["allow"] for r in judged) >= 57
    assert made.count() == df.count() and made.where("url_filter.allow is null").count() == 0


def test_url_model_is_a_distribution(spark):
    """Behind each context the probabilities of all characters sum to one."""
    seen = spark.createDataFrame([("abab", 3, True), ("abba", 1, False), ("b", 2, True)], "u string, n long, accepted boolean")
    table = {(r["kind"], r["gram"]): r["llr"] for r in urls.fit(seen).collect()}
    counts = {True: Counter(), False: Counter()}
    for text, n, ok in [("abab", 3, True), ("abba", 1, False), ("b", 2, True)]:
        padded = urls.START * urls.ORDER + text + urls.END
        for i in range(urls.ORDER, len(padded)):
            for k in range(urls.ORDER + 1):
                counts[ok][padded[i - k : i + 1]] += n

    def p(ok, gram):
        below = p(ok, gram[1:]) if len(gram) > 1 else urls.BASE
        total = sum(v for g, v in counts[ok].items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (counts[ok][gram] + urls.WEIGHT * below) / (total + urls.WEIGHT)

    for (kind, gram), llr in table.items():
        if kind == "g":
            assert llr == pytest.approx(np.log(p(True, gram) / p(False, gram)))


def test_url_models_keep_rare_grams(spark, monkeypatch):
    """However large the table is, no gram goes; and values are the same by broadcast and by shuffle."""
    seen = [("common", 10_000_000, True), ("commons/x", 7, False), ("rare", 1, False)]
    model = urls.fit(spark.createDataFrame(seen, "u string, n long, accepted boolean")).cache()
    table = {(r["kind"], r["gram"]): r["llr"] for r in model.collect()}
    grams = {p[i - k : i + 1] for p in (urls.START * urls.ORDER + u + urls.END for u, _, _ in seen) for i in range(urls.ORDER, len(p)) for k in range(urls.ORDER + 1)}
    assert {g for kind, g in table if kind == "g"} == grams

    def value(gram):
        if not gram:
            return 0.0
        return table[("g", gram)] if ("g", gram) in table else table.get(("c", gram[:-1]), 0.0) * (len(gram) > 1) + value(gram[1:])

    asked = ["rare", "common", "rares", "", "\u00e9 cora/", "m" * 300]
    want = {}
    for u in asked:
        p = urls.START * urls.ORDER + u + urls.END
        want[u] = sum(value(p[i - urls.ORDER : i + 1]) for i in range(urls.ORDER, len(p))) / (len(u) + 1)
    df = spark.createDataFrame([(u,) for u in asked], "u string")
    for share in (1 / 50_000, 0.02, 2.0):
        monkeypatch.setattr(urls, "HOT", share)
        assert dict(urls.score(df, model).collect()) == pytest.approx(want, abs=1e-9)


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, url_filter int")
    assert urls.url_filter(none, urls.RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert urls.url_filter(one, urls.RULES).where("url_filter.allow").count() == 2


# suffix-array dedup


@pytest.mark.parametrize("length", [40, 200])
def test_repeated_bytes(docs, plain_rows, length):
    made = suffixes.repeated_bytes(docs, length=length, out="found")
    assert same_columns(docs, made, "found")
    x = F.col("found")
    got = sorted(tuple(r) for r in made.select("doc_id", x["n_bytes"], x["n_removed"], F.size(x["removed"]), x["kept_sha256"]).collect())
    assert got == sorted(plain.repeated_bytes(plain_rows, length))


@pytest.mark.parametrize("seed", range(6))
def test_expansion_bounds(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + 1 + seed % 3, 300).astype(np.uint8)
    text[150:220] = text[20:90]
    text[[100, 230, 299]] = suffixes.BREAK
    raw, length = text.tobytes(), 12
    order, bound = suffixes.expansion(text, length)
    assert sorted(order.tolist()) == list(range(300))
    whole = lambda x: len(x) == length and bytes([suffixes.BREAK]) not in x
    for a, b, cut in zip(order, order[1:], bound[1:], strict=False):
        x, y = raw[a : a + length], raw[b : b + length]
        assert x <= y or not whole(x)
        if whole(x) or whole(y):
            assert cut == (x != y)


def test_repeated_bytes_of_odd_rows(empty, odd):
    assert suffixes.repeated_bytes(empty).count() == 0
    rows = [(i, r["text"]) for i, r in enumerate(odd.collect())]
    want = sorted(r[1:] for r in plain.repeated_bytes(rows, 200))
    x = F.col("repeats")
    assert sorted(tuple(r) for r in suffixes.repeated_bytes(odd).select(x["n_bytes"], x["n_removed"], F.size(x["removed"]), x["kept_sha256"]).collect()) == want


# mixing


def test_flight_keeps_sums():
    rng = random.Random(2)
    size = [float(rng.randint(0, 3000)) for _ in range(500)]
    due = [rng.random() for _ in size]
    pi = mixing.flight(list(due), [1.0] * 500, size, random.Random(1))
    assert sum(0 < p < 1 for p in pi) <= 2
    assert sum(pi) == pytest.approx(sum(due)) and sum(p * s for p, s in zip(pi, size, strict=True)) == pytest.approx(sum(p * s for p, s in zip(due, size, strict=True)))
    landed = mixing.flight(list(due), [1.0] * 500, size, random.Random(1), land=True)
    assert set(landed) <= {0.0, 1.0} and abs(sum(landed) - sum(due)) < 2


def test_flight_is_fair():
    """Over many coins each unit is taken about as often as its probability says."""
    due, size, taken = [0.2, 0.5, 0.8, 0.5, 0.3, 0.7], [5.0, 1.0, 9.0, 2.0, 2.0, 7.0], np.zeros(6)
    for s in range(3000):
        taken += mixing.flight(list(due), [1.0] * 6, size, random.Random(s), land=True)
    assert np.abs(taken / 3000 - due).max() < 0.04


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[k] for k in full)
        share = {k: left * weight[k] / sum(weight[j] for j in names if j not in full) for k in names if k not in full}
        over = {k for k, t in share.items() if t > most * sizes[k]}
        if not over:
            return {k: most * sizes[k] if k in full else share[k] for k in names}
        full |= over


def test_mix(docs):
    made = mixing.mix(docs)
    assert same_columns(docs, made, "mix")
    rows = made.select("doc_id", "text", "source", "mix.*").collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(plain.words(r["text"])) and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    for source, target in want.items():
        own = [r for r in rows if r["source"] == source]
        assert all(r["target"] == pytest.approx(target) and r["source_size"] == sizes[source] for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - target) <= max(0.02 * target, 50, max(r["size"] for r in own) - 1)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(5)).select("doc_id", "mix.copies").collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}


def test_mix_in_many_blocks(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 40), "big" if i % 3 else f"s{i % 5}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg(F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.first("mix.target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 20 for r in got)


def test_mix_of_odd_rows(empty, odd):
    assert mixing.mix(empty).count() == 0
    made = mixing.mix(odd)
    assert made.count() == 8 and made.where("mix.copies is null").count() == 0
    assert mixing.mixed(odd).columns == odd.columns


# substring dedup


@pytest.mark.parametrize("window", [5, 20])
def test_repeated_words(docs, plain_rows, window):
    made = substrings.repeated_words(docs, window=window)
    assert same_columns(docs, made, "repeats")
    x = F.col("repeats")
    got = sorted(tuple(r) for r in made.select("doc_id", x["n_words"], x["n_removed"], x["kept_sha256"]).collect())
    assert got == sorted(plain.repeated_words([(k, t or "") for k, t in plain_rows], window))


def test_repeated_words_of_odd_rows(empty, odd):
    assert substrings.repeated_words(empty).count() == 0
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.repeated_words(odd).select("doc_id", "repeats.n_words", "repeats.n_removed").collect())
    # The two rows of (7, text) are one document; null ids come after it.
    assert got[None, 80, 80] == 2 and got[9, 0, 0] == 1 and got[8, 0, 0] == 1 and sum(got.values()) == 8
    assert sorted(k for k in got if k[0] == 7) in ([(7, 80, 0), (7, 81, 80)], [(7, 80, 80), (7, 81, 0)])


# quality rules


def test_quality_counts(docs, plain_rows):
    made = quality.quality(docs)
    assert same_columns(docs, made, "quality")
    q = F.col("quality")
    got = {r[0]: tuple(r)[1:] for r in made.select("doc_id", *[q[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]).collect()}
    for k, t in plain_rows:
        assert got[k][:6] == plain.base_quality(t)
        assert not (got[k][5] and got[k][6])


def test_quality_bands():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aaeeioutnrslhdcm") for _ in range(rng.randint(2, 8)))
    known = [word() for _ in range(900)]
    prose = " ".join(rng.choice(known) for _ in range(700))
    noise = " ".join("".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(20)) for _ in range(200))
    pattern = " ".join(f"row {i} of the table is here now" for i in range(300))
    kept = [r["kept"] for r in quality.judge(pa.array([prose, noise, pattern, "#" * 50 + "\n" + prose])).to_pylist()]
    assert kept == [True, False, False, True]
    half = prose[:9000] + " " + "spam and eggs " * 2000
    assert quality.judge(pa.array([half])).to_pylist()[0]["kept"] is False


def test_quality_keeps_good_documents(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    x = quality.quality(docs.select("doc_id", "text"), out="q").join(labels.where("quality = 1"), "doc_id")
    assert x.where("not q.base_failed and not q.kept").count() == 0


def test_quality_of_odd_rows(empty, odd):
    assert quality.quality(empty).count() == 0 and quality.keep(empty).columns == empty.columns
    assert quality.quality(odd).where("quality.base_failed is null").count() == 0
    assert quality.keep(odd).count() == 5


# licences


def test_licences(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2021 Somebody Else <a@b.c>\n\n" + TEXTS["MIT"]
    shouted = mit.upper().replace("SUBLICENSE", "sub-licence").replace("\n", "\r\n")
    rows = [(1, mit), (2, shouted), (3, mit + " And more."), (4, None), (5, ""), (6, TEXTS["BSD-3-Clause"].replace("copyright holder", "copyright owner")), (7, "Text.\nreleased under the M.I.T License\nReleased under the MIT licence!"), (8, "© 2020 X\n" + TEXTS["ISC"].replace("noninfringement", "non-infringement"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licence string")
    made = licences.licences(df)
    got = {r["doc_id"]: r["licence"] for r in made.collect()}
    assert [got[i]["licence"] for i in range(1, 9)] == ["MIT titled with article", "MIT titled with article", None, None, None, "BSD-3-Clause", None, "ISC"]
    assert got[4]["digest"] is None and got[5]["digest"] == plain.sha("")
    assert list(got[7]["notices"]) == ["MIT"] and list(got[4]["notices"]) == []
    assert licences.licences(df.limit(0)).count() == 0


def test_every_known_licence_knows_itself(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "name string, text string")
    assert licences.licences(df).where("name != licence.licence or licence.licence is null").count() == 0


# n-gram Jaccard join


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (2, 50), (1, 30)])
def test_components(docs, plain_rows, width, percent):
    made = jaccard.similar(docs, width=width, percent=percent)
    assert same_columns(docs, made, "similar")
    got = {r[0]: (r[1], r[2]) for r in made.select("doc_id", "similar.n_shingles", "similar.component_id").collect()}
    assert got == plain.components(plain_rows, width, percent)


def test_components_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 4)
    monkeypatch.setattr(jaccard, "PLAN", 8)
    monkeypatch.setattr(jaccard, "HOT", 6)
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(90)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"y{rng.randrange(500)}" for _ in range(50)) + " " + " ".join(base[:40])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar(df, width=3, percent=82).select("doc_id", "similar.*").collect()}
    assert got == plain.components(rows, 3, 82)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_prefixes_of_low_and_high_shingles(spark, width, percent):
    """Short near copies, of which one lacks shingles that the others share: no link is lost where low and high shingles have the same documents."""
    rng = random.Random(width)
    texts = []
    for group in range(250):
        words = [f"g{group}x{i}" for i in range(rng.randint(18, 45))]
        texts += [" ".join(words[a : len(words) - b]) for a, b in ((0, 0), (0, rng.randint(0, 3)), (rng.randint(1, 3), 0), (rng.randint(0, 2), rng.randint(0, 2)))]
    want = plain.components(list(enumerate(texts)), width, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar(df, width=width, percent=percent).select("doc_id", "similar.n_shingles", "similar.component_id").collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 48, 120).astype(np.uint64)
    sets = []
    for _ in range(90):
        own = np.concatenate([rng.choice(base, rng.integers(60, 120), replace=False), rng.integers(0, 1 << 48, rng.integers(0, 40)).astype(np.uint64)])
        sets.append(np.unique(own))
    forest, want = jaccard.Forest(90), jaccard.Forest(90)
    jaccard.Tree(sets, 70).links(forest)
    for i in range(90):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [forest.root(i) for i in range(90)] == [want.root(i) for i in range(90)]


def test_contraction(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(25)] + [(95, 95)]
    labels = spark.range(100).select(F.col("id").alias("v"), F.col("id").alias("label"))
    got = {r["v"]: r["label"] for r in components.components(labels, spark.createDataFrame(edges, "a long, b long")).collect()}
    up = list(range(100))
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == dict(enumerate(up))


def test_representatives(docs, plain_rows, empty, odd):
    want = sorted(k for k, (n, c) in plain.components(plain_rows, 5, 80).items() if n == 0 or c == k)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert jaccard.similar(empty).count() == 0 and jaccard.similar(odd).count() == 8
    assert jaccard.representatives(odd).where("doc_id = 7").count() == 1


# decontamination


def test_contamination(spark, docs, plain_rows):
    items = [*ITEMS, (20, corpus()[0][:300]), (21, corpus()[1])]
    benchmark = spark.createDataFrame(items, BENCHMARK)
    texts = [*plain_rows, (900, "So THE quick, brown fox jumps over the lazy dog and then it sleeps! short-item here"), (901, "over the lazy dog and then it sleeps all day and over the lazy dog and then it sleeps all day long")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    for width, most in ((10, 1 << 20), (4, 1 << 20), (10, 40)):
        made = decontam.contamination(df, benchmark, width=width, max_bytes=most)
        for r in made.select("doc_id", "text", "contamination.*").collect():
            assert (r["n_words"], r["n_hit"], r["items"]) == plain.contamination(r["text"], named, width)
            raw = (r["text"] or "").encode()
            assert sum(x["end"] - x["start"] for x in r["runs"]) == r["n_hit"]
            for x in r["runs"]:
                assert len(plain.ALNUM.findall(raw[x["from_byte"] : x["to_byte"]].decode().translate(plain.LOWER))) == x["end"] - x["start"]


def test_decontaminate(spark, docs, empty, odd):
    benchmark = spark.createDataFrame(ITEMS[:1], BENCHMARK)
    passage = "the quick brown fox jumps over the lazy dog and then it sleeps"
    rows = [(1, "é before it all comes more text " * 5 + passage + ", after"), (2, passage + " x"), (3, "clean  text\n"), (4, None)]
    left = {r["doc_id"]: r["text"] for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert left == {1: "é before it all comes more text " * 5 + ", after", 3: "clean  text\n", 4: None}
    assert decontam.decontaminate(docs, benchmark.limit(0)).exceptAll(docs).count() == 0
    assert decontam.contamination(empty, benchmark).count() == 0 and decontam.contamination(odd, benchmark).count() == 8


# personal data

TEXT = "é mail bob.x+1@mail.example.com, a@b@c.d 1.2.3.4.5 300.1.1.1 4111 1111 1111 1111 and 4111-1111-1111-1112 call +49 (0) 30-123456 +1 😀 9999999999999995 10.0.0.255"


def test_base_kinds():
    for text in [TEXT, None, "", "x@y", "+1 2 3 4 5 6 7 8", "1" * 40, TEXT * 50]:
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.find(text) if s["base"]]
        assert got == plain.base_pii(text)


@pytest.mark.parametrize("seed", range(4))
def test_base_kinds_of_random_text(seed):
    rng = random.Random(seed)
    for _ in range(300):
        text = "".join(rng.choice("0123456789 ..--@+()ab4111") for _ in range(rng.randint(0, 60)))
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.find(text) if s["base"]] == plain.base_pii(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [s["kind"] for s in pii.find(t)]
    assert kinds("send it to IBAN DE89 3704 0044 0532 0130 00 today") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("my social security number is 123-45-6789") == ["ssn"] and kinds("order number 123-45-6789") == []
    assert kinds("phone 415-555-0132") == ["local_phone"] and kinds("part 415-555-0132") == []


def test_pii_columns(docs, plain_rows, empty, odd):
    made = pii.pii(docs)
    assert same_columns(docs, made, "pii")
    got = {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["base"]] for r in made.select("doc_id", "pii").collect()}
    assert got == {k: plain.base_pii(t) for k, t in plain_rows}
    assert pii.pii(empty).count() == 0 and pii.pii(odd).where("size(pii) = 0").count() == 8
    assert pii.redact(docs).columns == docs.columns


def test_redaction(spark):
    df = spark.createDataFrame([("write a@b.co or +49 30 123456",), (None,)], "text string")
    assert [r[0] for r in pii.redact(df).collect()] == ["write [email] or [phone]", None]


# kernels


@pytest.mark.parametrize("seed", range(4))
def test_words_and_windows(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab \n\té𝒳xyzlonger") for _ in range(rng.randint(0, 40))) for _ in range(50)] + [None, ""]
    got, seen = [], {}
    for _, _, data, offs in kernels.slices(pa.array(texts), 100):
        start, end, first = kernels.words(data, offs, kernels.SPACED)
        h = kernels.hash_words(data, start, end)
        raw = data.tobytes()
        for d in range(len(offs) - 1):
            got.append([raw[start[i] : end[i]].decode() for i in range(first[d], first[d + 1])])
            for i in range(first[d], first[d + 1]):
                assert seen.setdefault(int(h[i]), raw[start[i] : end[i]]) == raw[start[i] : end[i]]
    assert got == [plain.words(t) for t in texts]


def test_rolling():
    values = np.arange(10, dtype=np.uint64) % np.uint64(3)
    h = kernels.rolling(values, 4)
    assert len(h) == 7 and h[0] == h[3] == h[6] and len(set(h.tolist())) == 3

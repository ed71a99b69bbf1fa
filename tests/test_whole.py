"""Queries give whatever their tables hold, however many rows, keys or files these have."""

from __future__ import annotations

import hashlib
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from tidewater.operators import hotkeys
from tidewater.plans import catalog


def query(name, spark, folder):
    return catalog.queries()[name](spark, str(folder))


def python_slots(text, m, k):
    fnv, djb, sdbm = 2166136261, 5381, 0
    for c in map(ord, text):
        fnv, djb, sdbm = ((fnv ^ c) * 16777619) & 0xFFFFFFFF, (djb * 33 + c) & 0xFFFFFFFF, (sdbm * 65599 + c) & 0xFFFFFFFF
    return [((fnv + ((i * (djb ^ sdbm)) & 0xFFFFFFFF)) & 0xFFFFFFFF) % m for i in range(k)]


def test_probe_places_of_all_documents(spark, tmp_path):
    ids = [*range(40, 60), 200, 99_999, 1 << 40]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: list(r["slots"]) for r in query("bloom_probe_places", spark, tmp_path).collect()}
    assert got == {i: python_slots(str(i), 9600, 7) for i in ids}


def test_shuffle_keeps_all_customers(spark, tmp_path):
    spark.range(300).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = [(r["coin"], r["c_custkey"]) for r in query("coin_shuffle", spark, tmp_path).collect()]
    assert got == sorted((int(hashlib.md5(f"shuffle|{i}".encode()).hexdigest()[:8], 16) / 2**32, i) for i in range(300))


def test_dedup_of_many_files_out_of_order(spark, tmp_path):
    """Twenty files, read in three batches, the latest first: no event is dropped as late."""
    for f in range(20):
        rows = [(f * 5 + i, "view" if i % 2 else "purchase", datetime(2024, 2, 1) - timedelta(days=f, minutes=i)) for i in range(5)] + [(0, "purchase", datetime(2024, 2, 1))]
        spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert dict(query("stream_dedup", spark, tmp_path).collect()) == {"purchase": 60, "view": 40}


def test_approximate_hitters_are_near(spark, tmp_path):
    """Keys and counts within the sketch's error: 3.5 / tracked of all requests; exact where all keys are tracked."""
    keys = [k for k in range(600) for _ in range(3 + 4000 // (k + 1))]
    spark.createDataFrame([(k,) for k in keys], "l_partkey long").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    exact = Counter(keys)
    got = [tuple(r) for r in query("heavy_hitters_approx", spark, tmp_path).select("l_partkey", "requests").collect()]
    assert len(got) == 20 and all(exact[k] == n for k, n in got) and {k for k, _ in got} == {k for k, _ in exact.most_common(20)}
    rough = hotkeys.heavy_hitters_approx(spark.read.parquet(str(tmp_path / "lineitem.parquet")), "l_partkey", 5, tracked=200).collect()
    assert len(rough) == 5 and all(abs(r["requests"] - exact[r["l_partkey"]]) <= 3.5 / 200 * len(keys) for r in rough)


def halves(spark, folder):
    """Events at whole and half seconds of 40 minutes, of four types, by five users; every user and type has some at x.5, x even and odd."""
    rows = [(i, datetime(2024, 1, 1) + timedelta(milliseconds=500 * (i * 97 % 4800)), i % 5, ("view", "purchase", "click", "error")[i * 7 % 11 % 4], 1.0) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(folder / "events.parquet"))


def as_sql(name, spark, folder, threads=1):
    """The rows of a query and those of its SQL."""
    made = query(name, spark, folder)
    with duckdb.connect(config={"threads": threads}) as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        return sorted(map(tuple, made.collect()), key=repr), sorted(c.sql(catalog.oracle_sql()[name]).select(*made.columns).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["ttl_replay", "ttl_per_row", "cache_aside"])
def test_half_seconds_go_to_the_even_one(spark, tmp_path, name):
    halves(spark, tmp_path)
    got, wanted = as_sql(name, spark, tmp_path)
    assert got == wanted and got


def write_events(folder, *files):
    """Files of (event_id, second, user_id, event_type), read in this order."""
    (folder / "events.parquet").mkdir()
    with duckdb.connect() as c:
        for f, rows in enumerate(files):
            c.sql(f"CREATE TABLE e{f} (event_id BIGINT, second BIGINT, user_id BIGINT, event_type VARCHAR)")
            c.executemany(f"INSERT INTO e{f} VALUES (?, ?, ?, ?)", rows)
            c.sql(f"COPY (SELECT event_id, make_timestamp(second * 1000000) AS ts, user_id, event_type, 1.0::DOUBLE AS value FROM e{f}) TO '{folder}/events.parquet/{f}.parquet'")


@pytest.mark.parametrize("name", ["ttl_per_row", "cache_aside"])
def test_unknown_moments_hit_or_miss_unknown(spark, tmp_path, name):
    """User 1 has known moments and unknown ones, user 2 unknown ones alone, of which the first misses."""
    known = [(i, 100 + 2000 * (i % 7), 1, ("view", "purchase", "click")[i % 3]) for i in range(20, 60)]
    write_events(tmp_path, [*[(i, None, 1, "view") for i in range(5)], *known, *[(i, None, 2, "click") for i in range(70, 73)]])
    got, wanted = as_sql(name, spark, tmp_path)
    assert got == wanted and sum(r[1] is None for r in got) >= 5


@pytest.mark.parametrize("larger", [0, 1])
def test_ties_are_taken_alike_in_any_order_of_rows(spark, tmp_path, larger):
    """Two events alike in user, second and id: the shorter life is loaded, whichever file is read first (the larger); SQL leaves that open."""
    files = [[(1, 0, 5, "view"), (2, 5000, 5, "click")], [(1, 0, 5, "purchase")]]
    files[larger] += [(i, 20000 + i * i, 6, "error") for i in range(10, 500)]
    write_events(tmp_path, *files)
    got = sorted((r["event_id"], r["hit"]) for r in query("ttl_per_row", spark, tmp_path).where("user_id = 5").collect())
    assert got == [(1, False), (1, True), (2, False)]


@pytest.mark.parametrize("larger", [0, 1])
def test_writes_come_before_reads_of_the_same_id(spark, tmp_path, larger):
    """A write and a read share an id: the read misses, as in SQL, whichever file is read first (the larger)."""
    files = [[(1, 0, 5, "view"), (2, 60, 5, "view"), (3, 120, 5, "click")], [(2, 50, 5, "purchase")]]
    files[larger] += [(i, 20000 + i * i, 6, "error") for i in range(10, 500)]
    write_events(tmp_path, *files)
    got, wanted = as_sql("cache_aside", spark, tmp_path)
    assert got == wanted and {r[2:] for r in got if r[0] == 5} == {(1, False), (2, False), (3, True)}


@pytest.mark.parametrize("name", ["dense_snapshot", "written_snapshot", "board_ranks_by_counts"])
def test_sums_are_taken_in_the_order_of_events(spark, tmp_path, name):
    """1e17, -1e17 and 1000.0 come to 1000.0 in this order, to 992.0 if the sum of the second file is added to that of the first."""
    (tmp_path / "events.parquet").mkdir()
    values = [(7, 1e17), (8, 999.0), (None, 30.0), (9, None), (7, -1e17), (7, 1000.0), (8, 2.0), (None, 230.0)]
    with duckdb.connect() as c:
        c.sql("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
        c.executemany("INSERT INTO e VALUES (?, TIMESTAMP '2024-01-01 10:00:00', ?, 'view', ?)", [(i, *v) for i, v in enumerate(values)])
        for f, part in enumerate(("event_id < 4", "event_id >= 4")):
            c.sql(f"COPY (SELECT * FROM e WHERE {part} ORDER BY event_id) TO '{tmp_path}/events.parquet/{f}.parquet'")
    got, wanted = as_sql(name, spark, tmp_path)
    assert got == wanted and len(got) == 4
    assert {r["user_id"]: r["score"] for r in query(name, spark, tmp_path).collect()}[7] in (50, 4)

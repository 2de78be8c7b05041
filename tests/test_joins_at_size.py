"""Joins whose pairs outgrow their rows: what is shuffled follows the rows."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanweave.operators import overlap_join, overlap_sums


def shuffled_mb(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite() / 1e6


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """3000 orders on one sequence, each over all that begins behind it, two of them under one key, and 2000 events there and beyond."""
    path = str(tmp_path_factory.mktemp("crowded"))
    orders = spark.range(3000).select(F.least("id", F.lit(2998)).alias("o_orderkey"), F.lit(24_000_000).cast("long").alias("o_custkey"), F.lit(1.0).alias("o_totalprice"))
    orders.coalesce(2).write.parquet(f"{path}/orders.parquet")
    events = spark.range(2000).select((F.col("id") + F.when(F.col("id") % 5 == 0, 300_000).otherwise(0)).alias("event_id"), F.lit(48).cast("long").alias("user_id"))
    events.coalesce(2).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["range_self_join_residual", "range_self_join_whole"])
def test_self_join_deals_no_pair(spark, crowded, name):
    before = shuffled_mb(spark)
    found = {r.o_orderkey: r.n for r in __spark_entry__.queries()[name](spark, crowded).collect()}
    assert found == {k: 2999 for k in range(2998)} | {2998: 2 * 2998}
    assert shuffled_mb(spark) - before < 3


@pytest.mark.parametrize(("seed", "keys"), [(1, 400), (2, 90), (3, 1)])
def test_counts_of_other_keys(spark, seed, keys):
    draw = random.Random(seed)
    rows = [(draw.choice([*range(keys), None]), draw.choice(["a", "a", "b", None]), draw.choice([None, *[draw.randint(0, 200)] * 9]), draw.randint(0, 250)) for _ in range(300)]
    rows += [(k, rid, b, b + draw.choice([0, 3, 30])) for k, rid, b, _ in rows if b is not None] + rows[:9]
    met = lambda x, y: None not in (x[0], y[0], x[1], x[2], x[3], y[2], y[3]) and x[0] != y[0] and x[1] == y[1] and y[2] <= min(x[3], y[3]) and y[3] >= x[2]
    expected = {}
    for x in rows:
        expected[x[0]] = expected.get(x[0], 0) + sum(met(x, y) for y in rows)
    found = overlap_sums.other_counts(spark.createDataFrame(rows, "id int, rid string, beg int, end int"), "id").collect()
    assert len(found) == len(expected) and {r.id: r.n_overlaps for r in found} == expected


@pytest.mark.parametrize("name", ["range_left_join", "range_left_join_whole"])
def test_left_join_deals_no_pair(spark, crowded, name):
    before = shuffled_mb(spark)
    rows = __spark_entry__.queries()[name](spark, crowded)
    found = {r.event_id: (r.n, r.keys) for r in rows.groupBy("event_id").agg(F.count("o_orderkey").alias("n"), F.sum("o_orderkey").alias("keys")).collect()}
    keys = [min(k, 2998) for k in range(3000)]
    met = {e: [k for k in keys if k * 100 <= e * 150 <= k * 100 + 24_000_000] for e in (e + 300_000 * (e % 5 == 0) for e in range(2000))}
    assert found == {e: (len(x), sum(x) if x else None) for e, x in met.items()} and any(not x for x in met.values())
    assert shuffled_mb(spark) - before < 3


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
@pytest.mark.parametrize(("seed", "ranges", "copies"), [(1, 1, 10**6), (2, 2, 3), (3, 32, 3), (4, 1, 0.05)])
def test_ranges_at_one_place(spark, monkeypatch, how, seed, ranges, copies):
    """Short and long ranges, reversed ones, nulls, crowded places and places near the largest, whatever the stretches."""
    monkeypatch.setattr(overlap_join, "STRETCH_RANGES", ranges)
    monkeypatch.setattr(overlap_join, "MOST_COPIES", copies)
    draw = random.Random(seed)
    place = lambda: draw.choice([500, 501, draw.randint(0, 3000), draw.randint(0, 3000), draw.randint(0, 3000), 2**63 - 1 - draw.randint(300, 600)])
    named = lambda: draw.choice(["a", "a", "a", "b", None])
    queries = [(k, named(), b := draw.choice([None, *[place()] * 9]), None if b is None else b + draw.choice([-30, -1, 0, 0, 0, 1, 9, 200])) for k in range(300)]
    features = [(k, named(), b := place(), b + draw.choice([-1, 0, 1, 7, 40, 290])) for k in range(200)]
    features += [(200, "a", 0, 2900), (201, "b", 0, 2**60), (202, "c", 0, 10)]
    met = lambda q, f: None not in (q[1], q[2], f[1]) and q[1] == f[1] and f[2] <= f[3] and f[2] <= q[3] and f[3] >= q[2] and (q[0] + f[0]) % 3 > 0
    pairs = [(q[0], f[0]) for q in queries for f in features if met(q, f)]
    matched = {q for q, _ in pairs}
    q, f = spark.createDataFrame(queries, "id int, rid string, beg long, end long"), spark.createDataFrame(features, "id int, rid string, beg long, end long")
    got = overlap_join.range_join(q, f, how=how, residual="(id + id_f) % 3 > 0", strategy="bins")
    if how == "left":
        expected = pairs + [(q[0], None) for q in queries if q[0] not in matched]
        assert sorted(map(str, [(r.id, r.id_f) for r in got.collect()])) == sorted(map(str, expected)) and got.columns == [*q.columns, *(f"{c}_f" for c in f.columns)]
    else:
        assert sorted(r.id for r in got.collect()) == sorted(q[0] for q in queries if (q[0] in matched) == (how == "left_semi")) and got.columns == q.columns


@pytest.mark.parametrize(("one", "two"), [("int", "bigint"), ("double", "double"), ("int", "double"), ("struct<x:int>", "struct<x:int>")])
def test_names_of_any_type(spark, monkeypatch, one, two):
    monkeypatch.setattr(overlap_join, "STRETCH_RANGES", 1)
    name = lambda kind: F.struct((F.col("id") % 3).cast("int").alias("x")) if "struct" in kind else (F.col("id") % 3).cast(kind) * (F.lit(-1) if kind == "double" else F.lit(1))
    q = spark.range(60).select("id", (F.abs(name(one)) if one == "int" else name(one)).alias("rid"), F.col("id").alias("beg"), F.col("id").alias("end"))
    f = spark.range(60).select("id", (F.abs(name(two)) if one != two else name(two)).alias("rid"), F.col("id").alias("beg"), (F.col("id") + 5).alias("end"))
    got = overlap_join.range_join(q, f, how="left", strategy="bins")
    assert sorted((r.id, r.id_f) for r in got.collect()) == sorted((x, y) for x in range(60) for y in range(60) if x % 3 == y % 3 and y <= x <= y + 5)

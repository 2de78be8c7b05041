"""Counts without pairs, tables in tiles and levels told by partitions, against brute force."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from spanweave.operators import intervals, overlap_sums
from spanweave.plans import layout, tiles
from spanweave.plans.staging import shared_dir

ARGS = {"query": ("rid", "b", "e"), "feature": ("f_rid", "f_b", "f_e")}


def ranges(seed, skewed=False):
    """Ranges and features with nulls, ties, repeated rows, negative lengths and, if skewed, nearly all on one place of one sequence."""
    draw = random.Random(seed)
    place = (lambda: draw.choice([500, 501, 501, draw.randint(0, 3000)])) if skewed else (lambda: draw.randint(0, 300))
    names = ["a"] * 9 + ["b"] if skewed else ["a", "b", None]
    queries = [(k, draw.choice(names), draw.choice([None, place(), place(), place()]), place() + draw.choice([0, 5, 40])) for k in range(300)]
    features = [(k, draw.choice([*names, "c"]), b := place(), b + draw.choice([-1, 0, 0, 1, 7, 200])) for k in range(400)]
    return queries + queries[:5], features + features[:5]


def overlapping(query, features, ceiling=15):
    _, rid, b, e = query
    return [f for f in features if None not in (rid, b, e) and f[1] == rid and 0 <= f[3] - f[2] <= 16**ceiling and f[2] <= e and f[3] >= b]


def frames(spark, queries, features):
    return spark.createDataFrame(queries, "id int, rid string, b int, e int"), spark.createDataFrame(features, "f_id int, f_rid string, f_b int, f_e int")


@pytest.mark.parametrize(("seed", "skewed", "parts", "ceiling"), [(1, False, 4, 15), (2, True, 40, 15), (3, False, 1, 1), (4, True, 7, 0)])
def test_sums_equal_pairs(spark, seed, skewed, parts, ceiling):
    queries, features = ranges(seed, skewed)
    q, f = frames(spark, queries, features)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = overlap_sums.overlap_sums(q, f, ["id"], {"ids": "f_id", "odd": F.when(F.col("f_id") % 2 == 1, F.lit(0.5))}, ceiling=ceiling, **ARGS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {}
    for query in queries:
        met = overlapping(query, features, ceiling)
        one = expected.setdefault(query[0], [0, 0, 0.0])
        expected[query[0]] = [one[0] + len(met), one[1] + sum(x[0] for x in met), one[2] + sum(0.5 for x in met if x[0] % 2)]
    assert {r.id: [r.n_overlaps, r.ids, r.odd] for r in found} == expected and len(found) == len(expected)
    counted = overlap_sums.overlap_histogram(q, f, ["id"], ceiling=ceiling, **ARGS).collect()
    assert sum(r.n_queries for r in counted) == len(expected) and sum(r.n_overlaps * r.n_queries for r in counted) == sum(x[0] for x in expected.values())


@pytest.mark.parametrize("seed", [5, 6])
def test_shared_lengths_equal_pairs(spark, seed):
    queries, features = ranges(seed)
    found = overlap_sums.shared_lengths(*frames(spark, queries, features), ["id"], **ARGS).collect()
    expected = {}
    for query in queries:
        met = overlapping(query, features) if query[2] is not None and query[2] <= query[3] else []
        n, shared = expected.get(query[0], (0, 0))
        expected[query[0]] = (n + len(met), shared + sum(min(query[3], x[3]) - max(query[2], x[2]) for x in met))
    assert {r.id: (r.n_overlaps, r.shared) for r in found} == expected


def test_sums_list_no_pair(spark):
    """Every range overlaps every feature; the plan joins nothing that grows with the pairs."""
    q = spark.range(3000).select(F.col("id").cast("int").alias("id"), F.lit("a").alias("rid"), F.lit(0).alias("b"), F.lit(10**6).alias("e"))
    f = spark.range(3000).select(F.lit("a").alias("f_rid"), F.col("id").alias("f_b"), (F.col("id") + 5).alias("f_e"))
    rows = overlap_sums.overlap_counts(q, f, ["id"], **ARGS)
    assert {r.n_overlaps for r in rows.collect()} == {3000} and "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_nothing(spark):
    q, f = frames(spark, *ranges(1))
    assert overlap_sums.overlap_counts(q.filter("false"), f, ["id"], **ARGS).count() == 0
    assert {r.n_overlaps for r in overlap_sums.overlap_counts(q, f.filter("false"), ["id"], **ARGS).collect()} == {0}


@pytest.fixture
def place(spark):
    tag = uuid.uuid4().hex
    yield lambda name: (f"{name}_{tag}", f"{shared_dir(spark)}/{name}_{tag}")
    for name in ("q", "f", "g"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{tag}")


@pytest.mark.parametrize(("seed", "skewed"), [(1, False), (2, True)])
def test_tiled_join_gives_each_pair_once_without_a_shuffle(spark, place, monkeypatch, seed, skewed):
    monkeypatch.setattr(tiles, "TILE_ROWS", 16)
    monkeypatch.setattr(tiles.cut_tiles, "__defaults__", (16,))
    queries, features = ranges(seed, skewed)
    # A sequence that the tiles don't know is met too.
    features += [(900, "z", 5, 9)]
    queries += [(901, "z", 0, 5), (902, "zz", 0, 5)]
    q, f = frames(spark, queries, features)
    where = tiles.write_tiled(f, *place("f"), ("f_rid", "f_b", "f_e"), buckets=5)
    tiles.write_tiled(q, *place("q"), ("rid", "b", "e"), where, buckets=5)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = tiles.tiled_join(spark, place("q")[0], place("f")[0])
        found = sorted((r.id, r.f_id) for r in joined.collect())
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        own = tiles.tiled_join(spark, place("f")[0], place("f")[0], "f_id < f_id_f").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == sorted((query[0], x[0]) for query in queries for x in overlapping(query, features))
    assert joined.columns == [*q.columns, *f.columns]
    sound = [x for x in features if x[2] <= x[3]]
    assert sorted((r.f_id, r.f_id_f) for r in own if r.f_b <= r.f_e and r.f_b_f <= r.f_e_f) == sorted((x[0], y[0]) for x in sound for y in overlapping(x, features) if x[0] < y[0])
    assert tiles.read_tiled(spark, place("q")[0]).count() == len(queries)


def test_tables_of_different_tiles_are_not_joined(spark, place):
    q, f = frames(spark, *ranges(3))
    tiles.write_tiled(f, *place("f"), ("f_rid", "f_b", "f_e"), buckets=3)
    tiles.write_tiled(q, *place("q"), ("rid", "b", "e"), buckets=3)
    with pytest.raises(ValueError):
        tiles.tiled_join(spark, place("q")[0], place("f")[0])


def test_levels_are_told_without_a_job(spark):
    path = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([("a", 5, 5 + n) for n in (0, 10, 200, -3)], "rid string, b long, e long")
    indexed = intervals.with_range_columns(rows, "rid", "b", "e")
    layout.write_indexed(indexed, path)
    tracker = spark.sparkContext.statusTracker()
    table = layout.read_indexed(spark, path)
    spark.sparkContext.setJobGroup("levels", "levels")
    try:
        assert intervals.detect_levels(table) == (2, 0) == tuple(intervals.detect_levels(indexed.filter("true")))[:2]
        spark.sparkContext.setJobGroup("lookup", "lookup")
        found = intervals.lookup(table, "a", 100, 110)
        assert not tracker.getJobIdsForGroup("lookup")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.e for r in found.collect()] == [205]
    # An append is seen by reading anew, and what is made from a table scans for its levels.
    layout.write_indexed(intervals.with_range_columns(spark.createDataFrame([("a", 0, 10_000)], "rid string, b long, e long"), "rid", "b", "e"), path, mode="append")
    assert intervals.detect_levels(layout.read_indexed(spark, path)) == (4, 0)
    assert intervals.detect_levels(layout.read_indexed(spark, path).filter("e = 15")) == (1, 1)


def test_what_is_staged_in_a_scope_goes(spark):
    from spanweave.plans.staging import scope, staged

    with scope() as held:
        gone, kept = staged(spark.range(3).toDF("id"), "gone"), held.keep(staged(spark.range(4).toDF("id"), "kept"))
        assert gone.count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)not.exist"):
        gone.count()

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import intervals as iv
from spanweave.operators import overlap_join as oj
from spanweave.plans import layout


def features(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        beg = rng.randint(-300, 5000)
        length = rng.choice([0, 0, 1, 5, 16, 17, 200, 256, 257, 3000, -4])
        rows.append((rng.choice(["a", "b", None]), None if i % 41 == 0 else beg, beg + length, i))
    return spark.createDataFrame(rows, "rid string, beg bigint, end bigint, id bigint")


def overlapping(a, b):
    return a[0] is not None and a[0] == b[0] and None not in (a[1], a[2], b[1], b[2]) and b[2] - b[1] >= 0 and not (a[1] > b[2] or a[2] < b[1])


def test_levels_at_powers_of_sixteen(spark):
    rows = [(420, 420 + 16**k + d, -k if d < 1 else -k - 1) for k in range(16) for d in (-2, -1, 0, 1)]
    df = spark.createDataFrame(rows, "beg bigint, end bigint, expected int")
    got = iv.with_range_columns(df.withColumn("rid", F.lit(42)), "rid", "beg", "end")
    same, other = got.agg(F.sum((F.col("expected") == F.coalesce(iv.LVL, F.lit(999))).cast("int")), F.sum((F.col("expected") != F.coalesce(iv.LVL, F.lit(999))).cast("int"))).first()
    assert (same, other) == (62, 2)


def test_floor_lumps_short_features(spark):
    df = spark.createDataFrame([("a", 0, n) for n in (0, 1, 2, 16, 17, 256, 257)], "rid string, beg bigint, end bigint")
    got = iv.with_range_columns(df, "rid", "beg", "end", 2).groupBy(iv.LVL).count().orderBy(iv.LVL).collect()
    assert [tuple(r) for r in got] == [(-3, 1), (-2, 6)]
    with pytest.raises(ValueError):
        iv.with_range_columns(df, "rid", "beg", "end", 16)


def test_occupied_levels(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 0, 300), (None, 0, 70000), ("a", 5, 1)], "rid string, beg bigint, end bigint")
    indexed = iv.with_range_columns(df, "rid", "beg", "end")
    assert iv.detect_levels(indexed) == (3, 1)
    assert iv.detect_levels(indexed.filter("false")) == (15, 0)


def test_abutting_features_match(spark):
    for length in (1, 16, 4096):
        df = spark.createDataFrame([(1, 1000, 1000 + length)], "rid bigint, beg bigint, end bigint")
        indexed = iv.with_range_columns(df, "rid", "beg", "end")
        assert iv.lookup(indexed, 1, 900, 1000).count() == 1
        assert iv.lookup(indexed, 1, 900, 999).count() == 0
        assert iv.lookup(indexed, 1, 1000 + length, 9999).count() == 1
        assert iv.lookup(indexed, 1, 1001 + length, 9999).count() == 0


def test_lookups_against_brute_force(spark):
    df = features(spark)
    rows = df.collect()
    indexed = iv.with_range_columns(df, "rid", "beg", "end").withColumn("_rowid_", F.col("id")).cache()
    indexed.createOrReplaceTempView("t_features")
    iv.register_lookup(spark, "t_rowids", "t_features")
    rng = random.Random(5)
    for _ in range(6):
        beg = rng.randint(-400, 5200)
        q = ("a", beg, beg + rng.choice([0, 10, 700]))
        expected = sorted(r.id for r in rows if overlapping(q, r))
        assert [r[0] for r in iv.rowids(indexed, *q, rowid="id").collect()] == expected
        assert sorted(r.id for r in iv.lookup(indexed, *q).collect()) == expected
        assert sorted(r[0] for r in spark.sql(f"SELECT * FROM t_rowids('a', {q[1]}, {q[2]})").collect()) == expected
        text = iv.rowids_sql("t_features", spark=spark)
        assert [r[0] for r in spark.sql(f"SELECT * FROM {text}", args={"qrid": q[0], "qbeg": q[1], "qend": q[2]}).collect()] == expected
    assert iv.lookup(indexed, "a", -1000, 9000, 1, 0).filter("end - beg > 16").isEmpty()
    with pytest.raises(ValueError):
        iv.overlaps("a", 0, 1, 3, 4)
    with pytest.raises(ValueError):
        iv.register_lookup(spark, "no_rowids", "t_plain") if spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("t_plain") is None else None


@pytest.mark.parametrize("strategy", ["bins", "broadcast"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_overlap_joins_against_brute_force(spark, strategy, how):
    left, right = features(spark, 120, 7), features(spark, 160, 9)
    a, b = left.collect(), right.collect()
    residual = "id <> id_f"
    pairs = [(x.id, y.id) for x in a for y in b if overlapping(x, y) and x.id != y.id]
    matched = {x for x, _ in pairs}
    got = oj.range_join(left, right, how=how, strategy=strategy, residual=residual)
    if how in ("inner", "left"):
        lone = [(x.id, None) for x in a if x.id not in matched] if how == "left" else []
        assert sorted(map(str, [(r.id, r.id_f) for r in got.collect()])) == sorted(map(str, pairs + lone))
    else:
        assert sorted(r.id for r in got.collect()) == sorted(x.id for x in a if (x.id in matched) == (how == "left_semi"))


def test_empty_sides(spark):
    left, none = features(spark, 30), features(spark, 30).filter("false")
    assert oj.range_join(left, none, strategy="bins").count() == 0
    assert oj.range_join(left, none, how="left", strategy="bins").count() == 30
    assert oj.range_join(none, left, strategy="bins").count() == 0


def test_bin_join_plan_has_no_nested_loop(spark):
    df = features(spark)
    plan = oj.range_join(df, df, strategy="bins")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_layout_prunes_partitions(spark, tmp_path):
    indexed = iv.with_range_columns(features(spark), "rid", "beg", "end")
    layout.write_indexed(indexed, str(tmp_path / "t"), 4)
    found = layout.read_indexed(spark, str(tmp_path / "t"))
    got = iv.lookup(found, "a", 100, 400, 2, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and iv.LVL in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert got.count() == iv.lookup(indexed, "a", 100, 400, 2, 1).count()
    layout.compact(spark, str(tmp_path / "t"), str(tmp_path / "c"), ["_gri_beg"], 2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 300


def test_rowids_are_dense(spark):
    df = layout.with_rowids(features(spark), "rid", "beg", "id")
    assert sorted(r[0] for r in df.select("_rowid_").collect()) == list(range(1, 301))


def test_circular_and_scan(spark):
    df = spark.createDataFrame([("m", 95, 105, 1), ("m", 2, 4, 2), ("m", 50, 60, 3)], "rid string, beg bigint, end bigint, id bigint")
    indexed = iv.with_range_columns(df, "rid", "beg", "end")
    assert sorted(r.id for r in iv.circular_lookup(indexed, "m", 1, 4, 100).collect()) == [1, 2]
    assert sorted(r.id for r in iv.scan_from_first(indexed.withColumn("_rowid_", F.col("id")), "m", 2, 4).collect()) == [2, 3]


def test_streaming_lookup(spark, tmp_path):
    from spanweave.streaming.lookups import stream_overlaps

    queries, feats = features(spark, 60, 11), features(spark, 80, 13)
    queries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    run = stream_overlaps(stream, feats).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    expected = sorted((x.id, y.id) for x in queries.collect() for y in feats.collect() if overlapping(x, y))
    assert sorted((r.id, r.id_f) for r in spark.table("found").collect()) == expected

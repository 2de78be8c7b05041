"""Joins around the origin of circular sequences, schemas of their own, and lookups by name through Bloom filters."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from spanweave.operators import refseq
from spanweave.operators.circular import circular_join
from spanweave.operators.overlap_join import range_join
from spanweave.plans import layout
from spanweave.plans.session import Attached
from spanweave.plans.staging import shared_dir

LENGTHS = {1: 1000, 2: 50, 3: 1000}


@pytest.fixture(scope="module")
def refseqs(spark):
    return refseq.put_sequences(refseq.empty(spark), [refseq.RefSeq(k, f"s{k}", n, None, None, {"circular": True} if k < 3 else {}) for k, n in LENGTHS.items()])


def around(query, feature):
    """Whether a range and a feature share a place, by the turns that the sequence allows."""
    (_, rid, b, e), (_, f_rid, f_b, f_e) = query, feature
    if None in (rid, b, e) or rid != f_rid or f_e < f_b:
        return False
    return any(f_b <= e + t and f_e >= b + t for t in ([0, LENGTHS[rid], -LENGTHS[rid]] if rid in (1, 2) else [0]))


def test_circular_joins_give_each_pair_once(spark, refseqs):
    draw = random.Random(7)
    spans = lambda k: (k, r := draw.choice([1, 1, 2, 3, 4]), b := draw.randint(0, 1000 if r != 2 else 50), b + draw.choice([0, 3, 40, 60, 900, -2]))
    queries = [spans(k) for k in range(250)] + [(900, None, 1, 2), (901, 1, None, 5), (902, 1, 990, 1990), (902, 1, 990, 1990)]
    features = [spans(k) for k in range(250)] + [(900, 1, 995, 1010), (901, 2, 49, 99), (901, 2, 49, 99)]
    q = spark.createDataFrame(queries, "id int, rid long, b long, e long")
    f = spark.createDataFrame(features, "id int, rid long, b long, e long")
    args = {"query": ("rid", "b", "e"), "feature": ("rid", "b", "e")}
    expected = sorted((x[0], y[0]) for x in queries for y in features if around(x, y))
    assert sorted((r.id, r.id_f) for r in circular_join(q, f, refseqs, **args).collect()) == expected
    alone = sorted(x[0] for x in queries if not any(around(x, y) for y in features))
    left = circular_join(q, f, refseqs, how="left", **args).collect()
    assert sorted((r.id, r.id_f) for r in left if r.id_f is not None) == expected and sorted(r.id for r in left if r.id_f is None) == alone
    assert sorted(r.id for r in circular_join(q, f, refseqs, how="left_anti", **args).collect()) == alone
    assert sorted(r.id for r in circular_join(q, f, refseqs, how="left_semi", **args).collect()) == sorted(x[0] for x in queries if x[0] not in alone)
    # Without circular sequences it is the plain join.
    plain = circular_join(q, f, refseqs.filter("_gri_rid = 3"), **args)
    assert sorted((r.id, r.id_f) for r in plain.collect()) == sorted((r.id, r.id_f) for r in range_join(q, f, **args).collect())
    assert circular_join(q.filter("false"), f, refseqs, **args).count() == 0 and circular_join(q, f.filter("false"), refseqs, **args).count() == 0


def test_tables_of_two_schemas(spark):
    tag = uuid.uuid4().hex
    one, two = f"one_{tag}", f"two_{tag}"
    folder = lambda name: f"{shared_dir(spark)}/{name}"
    spark.createDataFrame([(1, "a", 5, 9), (2, "a", 40, 90), (3, None, 1, 2)], "_rowid_ bigint, rid string, beg bigint, end bigint").write.parquet(f"{folder(one)}/exons.parquet")
    spark.createDataFrame([(7, "a", 8, 8), (8, "b", 8, 8), (9, "a", 9, 40)], "id bigint, rid string, beg bigint, end bigint").write.partitionBy("rid").parquet(f"{folder(two)}/exons.parquet")
    spark.range(3).write.parquet(f"{folder(two)}/other.parquet")
    engine = Attached(spark)
    try:
        assert engine.attach_schema(folder(one), one) == [f"{one}.exons"]
        assert engine.attach_schema(folder(two), two) == [f"{two}.exons", f"{two}.other"]
        assert engine.index_table(f"{one}.exons", "rid", "beg", "end") == f"{one}.exons_gri"
        rows = spark.sql(f"SELECT q.id, t._rowid_ FROM {two}.exons q LEFT JOIN LATERAL {one}_exons_rowids(q.rid, q.beg, q.end) t ORDER BY 1, 2").collect()
        assert [tuple(r) for r in rows] == [(7, 1), (8, None), (9, 1), (9, 2)]
        assert tuple(spark.sql(f"SELECT * FROM {one}_exons_levels()").first()) == (2, 1)
        pairs = range_join(spark.table(f"{two}.exons"), spark.table(f"{one}.exons"), ("rid", "beg", "end"), ("rid", "beg", "end"))
        assert sorted((r.id, r["_rowid_"]) for r in pairs.collect()) == [(7, 1), (9, 1), (9, 2)]
        # What is appended is seen; forgetting a schema keeps its files.
        spark.createDataFrame([(4, "b", 0, 99)], "_rowid_ bigint, rid string, beg bigint, end bigint").write.mode("append").parquet(f"{folder(one)}/exons.parquet")
        spark.catalog.refreshTable(f"{one}.exons")
        assert spark.sql(f"SELECT count(*) FROM {one}_exons_rowids('b', 5, 5)").first()[0] == 1
    finally:
        engine.detach_schema(one), engine.detach_schema(two)
    assert spark.read.parquet(f"{folder(one)}/exons.parquet").count() == 4 and not spark.catalog.databaseExists(one)


def test_bloom_filters_skip_row_groups(spark):
    path = f"{shared_dir(spark)}/names-{uuid.uuid4().hex}"
    rows = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("name"), F.col("id").alias("place"))
    small = {"parquet.block.size": str(1 << 16), "parquet.page.size": str(1 << 12), "parquet.block.size.row.check.min": "100"}
    for kind, options in (("plain", {}), ("bloom", layout.bloom_options(["name"]))):
        rows.coalesce(2).write.options(**small, **options).parquet(f"{path}/{kind}")
    name = rows.filter("place = 12345").first()["name"]

    def scanned(kind):
        found = spark.read.parquet(f"{path}/{kind}").filter(F.col("name") == name)
        result = [r.place for r in found.collect()]
        leaf = found._jdf.queryExecution().executedPlan()
        leaves = leaf.collectLeaves()
        plan = leaves.head()
        while plan.nodeName().startswith(("AdaptiveSparkPlan", "ResultQueryStage")):
            plan = plan.plan() if plan.nodeName().startswith("ResultQueryStage") else plan.executedPlan()
        leaves = plan.collectLeaves()
        return result, leaves.head().metrics().apply("numOutputRows").value()

    (plain, all_rows), (bloom, few_rows) = scanned("plain"), scanned("bloom")
    assert plain == bloom == [12345] and few_rows < all_rows / 4, (few_rows, all_rows)

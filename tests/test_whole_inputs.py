"""Queries over whole tables, against their SQL and against counts of the input."""

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
JOINS = ("range_left_join_whole", "range_self_join_whole", "range_semi_whole", "range_anti_whole", "refseq_join_name_whole")


def expected_of(name, columns):
    con = duckdb.connect()
    for table in ("orders", "events", "nation", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()


@pytest.mark.parametrize("name", JOINS)
def test_against_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SMALL)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert key(got.collect()) == key(expected_of(name, got.columns))


def test_joins_read_every_row(spark):
    queries = __spark_entry__.queries()
    orders = {r.o_orderkey for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect()}
    assert {r.o_orderkey for r in queries["range_self_join_whole"](spark, SMALL).collect()} == orders
    found = {r.o_orderkey for r in queries["range_left_join_whole"](spark, SMALL).collect()} - {None}
    assert any(k % 7 for k in found)
    customers = spark.read.parquet(f"{SMALL}/customer.parquet").filter("c_nationkey > 0").count()
    assert sum(r.n for r in queries["refseq_join_name_whole"](spark, SMALL).collect()) == customers

"""Queries over whole texts, against their SQL and the letters of the input."""

import re

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
TEXTS = ("dna_revcomp_whole", "twobit_size_whole", "twobit_roundtrip_dna_whole", "twobit_roundtrip_rna_whole", "twobit_substr_whole")


def expected_of(name, columns):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    return con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()


@pytest.mark.parametrize("name", TEXTS)
def test_against_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SMALL)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert key(got.collect()) == key(expected_of(name, got.columns))


def test_sequences_are_whole_texts(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.dna for r in __spark_entry__.queries()["twobit_roundtrip_dna_whole"](spark, SMALL).collect()}
    assert {k: len(v) for k, v in got.items()} == {k: len(re.sub("[^A-Za-z]", "", t)) for k, t in texts.items()}
    assert max(map(len, got.values())) > 10_000

"""The dimension table of reference sequences."""

from __future__ import annotations

import json
from collections.abc import Iterable
from importlib import resources
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("_gri_rid", T.LongType(), False), T.StructField("gri_refseq_name", T.StringType(), False),
    T.StructField("gri_assembly", T.StringType()), T.StructField("gri_refget_id", T.StringType()),
    T.StructField("gri_refseq_length", T.LongType(), False), T.StructField("gri_refseq_meta_json", T.StringType(), False),
])
ASSEMBLIES = {"GRCh38_no_alt_analysis_set": "grch38_no_alt.tsv"}


class RefSeq(NamedTuple):
    rid: int
    name: str
    length: int
    assembly: str | None
    refget_id: str | None
    meta: dict


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _printable(x: str | None) -> str | None:
    if x and not (x.isascii() and x.isprintable()):
        raise ValueError(f"not printable ASCII: {x!r}")
    return x or None


def put_sequences(refseqs: DataFrame, sequences: Iterable[RefSeq]) -> DataFrame:
    """`refseqs` with further sequences, checked together; a negative rid takes the next free one, from 1."""
    last, rows = refseqs.agg(F.max("_gri_rid")).first()[0] or 0, []
    for x in sequences:
        rid = last + 1 if x.rid < 0 else x.rid
        last = max(last, rid)
        rows.append((rid, _printable(x.name), _printable(x.assembly), _printable(x.refget_id), x.length, json.dumps(x.meta or {}, separators=(",", ":"))))
    return checked(refseqs.unionByName(refseqs.sparkSession.createDataFrame(rows, SCHEMA)))


def put_sequence(refseqs: DataFrame, name: str, length: int, assembly: str | None = None, refget_id: str | None = None, meta: dict | None = None, rid: int = -1) -> DataFrame:
    """`refseqs` with one sequence more."""
    return put_sequences(refseqs, [RefSeq(rid, name, length, assembly, refget_id, meta or {})])


def put_assembly(refseqs: DataFrame, assembly: str = "GRCh38_no_alt_analysis_set") -> DataFrame:
    """`refseqs` with all sequences of a bundled assembly, numbered on in the assembly's order."""
    if assembly not in ASSEMBLIES:
        raise ValueError(f"unknown assembly: {assembly}")
    first = (refseqs.agg(F.max("_gri_rid")).first()[0] or 0) + 1
    lines = resources.files("spanweave.data").joinpath(ASSEMBLIES[assembly]).read_text().splitlines()
    parts = [x.split("\t") for x in lines if not x.startswith("#")]
    rows = [(first + i, name, assembly, refget, int(length), "{}") for i, (name, length, refget) in enumerate(parts)]
    return checked(refseqs.unionByName(refseqs.sparkSession.createDataFrame(rows, SCHEMA)))


def checked(refseqs: DataFrame) -> DataFrame:
    """Raises if ids, (assembly, name) or refget ids repeat."""
    for key in (("_gri_rid",), ("gri_assembly", "gri_refseq_name"), ("gri_refget_id",)):
        twice = refseqs.dropna(subset=list(key)).groupBy(*key).count().filter("count > 1").first()
        if twice:
            raise ValueError(f"{', '.join(key)} repeats: {tuple(twice)[:-1]}")
    return refseqs


def by_rid(refseqs: DataFrame, assembly: str | None = None) -> dict[int, RefSeq]:
    """The sequences by id; this table is a small dimension."""
    rows = refseqs.filter(F.col("gri_assembly") == assembly) if assembly else refseqs
    return {r[0]: RefSeq(r[0], r[1], r[4], r[2], r[3], json.loads(r[5])) for r in rows.select(*SCHEMA.names).collect()}


def by_name(refseqs: DataFrame, assembly: str | None = None) -> dict[str, RefSeq]:
    found = list(by_rid(refseqs, assembly).values())
    if len({x.name for x in found}) < len(found):
        raise ValueError("sequence names aren't unique; choose an assembly")
    return {x.name: x for x in found}


def with_names(df: DataFrame, refseqs: DataFrame, rid: str = "_gri_rid") -> DataFrame:
    """Adds the columns of the sequence that `rid` names; rows without one go."""
    return df.join(refseqs.withColumnRenamed("_gri_rid", rid), rid)


def with_rids(df: DataFrame, refseqs: DataFrame, name: str, assembly: str | None = None) -> DataFrame:
    """Adds _gri_rid by sequence name."""
    names = refseqs.filter(F.col("gri_assembly") == assembly) if assembly else refseqs
    return df.join(names.select("_gri_rid", F.col("gri_refseq_name").alias(name)), name)

"""Sequence alignment text (SAM)."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import refseq
from ..operators.intervals import with_range_columns
from ..plans.layout import with_rowids
from .headers import header_lines, text_lines

#: Tags of a read group that are kept (fixed values).
READ_GROUP_TAGS = ("BC", "CN", "DS", "DT", "FO", "KS", "LB", "PG", "PI", "PL", "PM", "PU", "SM")


class Sam(NamedTuple):
    readgroups: DataFrame
    reads: DataFrame
    seqs: DataFrame
    tags: DataFrame
    refseqs: DataFrame


def _fields(line: str) -> dict[str, str]:
    return dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)


def _aligned(cigar: Column) -> Column:
    """Reference positions that an alignment covers."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint"))


def read_sam(spark: SparkSession, path: str, assembly: str | None = None, gri: bool = True) -> Sam:
    """Tables of a SAM file, or of a folder of files that share the header of the first.

    readgroups: (rg_id, rg_name, rg_tags_json); reads: (rowid, flag, rid, pos
    zero-based, endpos, mapq, cigar, rnext, pnext, tlen, rg_id); seqs: (rowid,
    qname, seq, qual); tags: (rowid, tags_json).  What the format leaves open
    is null.
    """
    lines = text_lines(spark, path)
    head = header_lines(spark, path, "@")
    groups = [_fields(x) for x in head if x.startswith("@RG\t")]
    if any("ID" not in g for g in groups):
        raise ValueError("a read group lacks ID")
    rows = [(i, g["ID"], json.dumps({k: g[k] for k in READ_GROUP_TAGS if k in g}, separators=(",", ":"), ensure_ascii=False)) for i, g in enumerate(groups)]
    readgroups = spark.createDataFrame(rows, "rg_id bigint, rg_name string, rg_tags_json string")
    sequences = [_fields(x) for x in head if x.startswith("@SQ\t")]
    if any("SN" not in s or "LN" not in s for s in sequences):
        raise ValueError("a sequence lacks SN or LN")
    refseqs = spark.createDataFrame([(i, s["SN"], assembly or s.get("AS"), s.get("M5"), int(s["LN"]), "{}") for i, s in enumerate(sequences)], refseq.SCHEMA)

    f = lambda i: F.get("f", F.lit(i))
    known = lambda i: F.when(f(i) != "*", f(i))
    body = lines.filter(~F.col("line").startswith("@") & (F.col("line") != ""))
    # Staged with their numbers, so that reads, sequences and tags name the same lines, equal lines too.
    body = with_rowids(body.select("line"), name="rowid").select(F.split("line", "\t").alias("f"), "rowid")
    rids = F.create_map(*[x for i, s in enumerate(sequences) for x in (F.lit(s["SN"]), F.lit(i).cast("bigint"))]) if sequences else F.create_map().cast("map<string,bigint>")
    rg_ids = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g["ID"]), F.lit(i).cast("bigint"))]) if groups else F.create_map().cast("map<string,bigint>")
    aux = F.transform(F.filter(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda x: x.contains(":")), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("k"), F.split_part(x, F.lit(":"), F.lit(2)).alias("t"), F.regexp_replace(x, "^[^:]*:[^:]*:", "").alias("v")))
    body = body.withColumn("_aux", aux).withColumn("_rg", F.get(F.filter("_aux", lambda x: x["k"] == "RG"), F.lit(0))["v"])
    number = lambda i: f(i).cast("bigint")
    pos = F.when(number(3) >= 1, number(3) - 1)
    covered = _aligned(f(5))
    rg = F.when(F.col("_rg").isNotNull(), F.coalesce(F.element_at(rg_ids, F.col("_rg")), F.raise_error(F.concat(F.lit("unknown read group "), "_rg")).cast("bigint")))
    mate = F.when(f(6) == "=", f(2)).otherwise(f(6))
    reads = body.select(
        "rowid", number(1).alias("flag"), F.try_element_at(rids, f(2)).alias("rid"), pos.alias("pos"),
        F.when(pos.isNotNull(), pos + F.when((covered > 0) & (number(1).bitwiseAND(F.lit(4)) == 0), covered).otherwise(1)).alias("endpos"), number(4).alias("mapq"), known(5).alias("cigar"),
        F.try_element_at(rids, mate).alias("rnext"), F.when(number(7) >= 1, number(7) - 1).alias("pnext"), F.when(number(8) != 0, number(8)).alias("tlen"), rg.alias("rg_id"),
    )
    seqs = body.select("rowid", f(0).alias("qname"), known(9).alias("seq"), known(10).alias("qual"))
    quoted = lambda v: F.substr(F.to_json(F.array(v)), F.lit(2), F.length(F.to_json(F.array(v))) - 2)
    items = F.transform(F.filter("_aux", lambda x: x["k"] != "RG"), lambda x: F.concat(quoted(x["k"]), F.lit(":"), F.when(x["t"] == "i", x["v"]).otherwise(quoted(x["v"]))))
    tags = body.select("rowid", F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")).alias("tags_json"))
    if gri:
        reads = with_range_columns(reads, F.col("rid"), F.col("pos"), F.col("endpos"))
    return Sam(readgroups, reads, seqs, tags, refseqs)

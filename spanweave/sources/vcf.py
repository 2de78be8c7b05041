"""Variant call text: exploded into variants, samples and genotypes, or kept by line.

Files are read as text (gzip included), so their splits are Spark's; the
header is parsed by the driver and decides the columns.  The files of a folder
share the header of the first; a line of a contig that it doesn't name, or with
calls of more samples than it names, is an error.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import refseq
from ..operators.intervals import with_range_columns
from ..plans.layout import with_rowids
from .headers import header_lines, structured, text_lines

_FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


class Vcf(NamedTuple):
    variants: DataFrame
    samples: DataFrame | None
    genotypes: DataFrame | None
    refseqs: DataFrame


def _json_list(items: Column) -> Column:
    kept = F.filter(items, lambda x: (x != ".") & (x != ""))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def _numbers(text: Column, kind: str) -> Column:
    """A JSON array of numbers with null for missing ones; null if all are."""
    values = F.transform(F.split(text, ","), lambda x: F.when(x == ".", F.lit(None)).otherwise(x.cast(kind)))
    return F.when(F.exists(values, lambda x: x.isNotNull()), F.to_json(values))


def _typed(text: Column, number: str, kind: str, one_or_list: bool = False) -> Column:
    given = F.when((text != ".") & (text != ""), text)
    if kind not in ("Integer", "Float"):
        return given
    spark_type = "bigint" if kind == "Integer" else "double"
    if number != "1":
        listed = _numbers(given, spark_type)
        return F.when(F.size(F.split(given, ",")) > 1, listed).otherwise(given.try_cast(spark_type).cast("string")) if one_or_list else listed
    return given.try_cast(spark_type)


def _column_name(field: dict[str, str]) -> str:
    listed = field["Number"] != "1" and field["Type"] in ("Integer", "Float")
    return field["ID"] + ("_jsarray" if listed else "")


def read_vcf(spark: SparkSession, path: str, ploidy: int = 2, assembly: str | None = None, gri: bool = True) -> Vcf:
    """Tables of a VCF file.

    variants: (variant_rowid, rid, POS zero-based, rlen, ID_jsarray, REF,
    ALT_jsarray, QUAL, FILTER_jsarray, INFO columns); samples: (sample_id,
    sample_name); genotypes: (variant_rowid, sample_id, GT1.., GT_ploidy, FORMAT
    columns), GT_ploidy negative where phased.  rid is the contig's place in
    the header, from 0.
    """
    lines = text_lines(spark, path)
    head = header_lines(spark, path, "#")
    contigs = structured(head, "contig", ("ID", "length"))
    if not contigs:
        raise ValueError("the header has no contig lines")
    if len({c["ID"] for c in contigs}) < len(contigs):
        raise ValueError("the header names a contig twice")
    named = {c.get("assembly") for c in contigs} - {None}
    if len(named) > 1:
        raise ValueError(f"contigs of several assemblies: {sorted(named)}")
    info, formats = structured(head, "INFO", ("ID", "Number", "Type")), structured(head, "FORMAT", ("ID", "Number", "Type"))
    titles = next((x for x in head if x.startswith("#CHROM")), "#" + "\t".join(_FIXED[:8])).split("\t")
    sample_names = titles[9:]
    assembly = assembly or next(iter(named), None)
    refseqs = spark.createDataFrame([(i, c["ID"], assembly, c.get("md5"), int(c["length"]), "{}") for i, c in enumerate(contigs)], refseq.SCHEMA)

    parts = lines.filter(~F.col("line").startswith("#") & (F.col("line") != "")).select(F.split("line", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    fields = F.filter(F.split(at(7), ";"), lambda x: (x != ".") & (x != ""))
    pairs = F.map_from_entries(F.transform(fields, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).alias("v"))))
    rows = parts.select(
        at(0).alias("CHROM"), (at(1).cast("bigint") - 1).alias("POS"), at(2).alias("_id"), at(3).alias("REF"), at(4).alias("_alt"),
        at(5).try_cast("double").alias("QUAL"), at(6).alias("_filter"), pairs.alias("_info"), F.split(at(8), ":").alias("_keys"),
        F.when(F.size("f") > 9 + max(len(sample_names), 0 if len(titles) > 8 else 10**9), F.raise_error(F.lit("a line has more calls than the header has samples")).cast("array<string>"))
        .otherwise(F.slice("f", 10, max(1, len(sample_names)))).alias("_calls"),
    )
    ids = refseqs.select(F.col("_gri_rid").alias("_rid"), F.col("gri_refseq_name").alias("CHROM"))
    rows = rows.join(F.broadcast(ids), "CHROM", "left")  # as many rows as the header has contigs
    unknown = F.raise_error(F.concat(F.lit("contig not in the header: "), "CHROM")).cast("bigint")
    rows = rows.withColumn("rid", F.coalesce("_rid", unknown))
    end = F.element_at("_info", "END").try_cast("bigint")
    rows = rows.withColumn("rlen", F.when(end > F.col("POS"), end - F.col("POS")).otherwise(F.length("REF")).cast("bigint"))
    # Staged with their numbers, so that variants and genotypes name the same rows.
    rows = with_rowids(rows.drop("_rid", "CHROM"), "rid", "POS", "REF", "_alt", "_id", "QUAL", name="variant_rowid")
    columns = [
        "variant_rowid", "rid", "POS", "rlen", _json_list(F.split("_id", ";")).alias("ID_jsarray"), "REF",
        F.coalesce(_json_list(F.split("_alt", ",")), F.lit("[]")).alias("ALT_jsarray"), "QUAL", _json_list(F.split("_filter", ";")).alias("FILTER_jsarray"),
    ]
    for field in info:
        text = F.element_at("_info", field["ID"])
        value = F.map_contains_key("_info", field["ID"]).cast("int") if field["Type"] == "Flag" else _typed(text, field["Number"], field["Type"])
        columns.append(value.alias(_column_name(field)))
    variants = rows.select(*columns)
    if gri:
        variants = with_range_columns(variants, F.col("rid"), F.col("POS"), F.col("POS") + F.col("rlen"))
    if not sample_names:
        return Vcf(variants, None, None, refseqs)
    samples = spark.createDataFrame(list(enumerate(sample_names)), "sample_id bigint, sample_name string")
    called = rows.select("variant_rowid", "_keys", F.posexplode("_calls").alias("sample_id", "_call")).withColumn("sample_id", F.col("sample_id").cast("bigint"))
    entry = called.withColumn("_values", F.map_from_arrays("_keys", F.transform(F.sequence(F.lit(0), F.size("_keys") - 1), lambda i: F.get(F.split("_call", ":"), i))))
    gt = F.element_at("_values", "GT")
    alleles = F.split(gt, r"[/|]")
    too_many = F.when(F.size(alleles) > ploidy, F.raise_error(F.lit(f"more than {ploidy} alleles: set ploidy")).cast("array<string>")).otherwise(alleles)
    allele = lambda i: F.get(too_many, F.lit(i)).try_cast("bigint")
    known = F.size(F.filter(alleles, lambda x: x != "."))
    phased = F.when(gt.contains("|"), -known).otherwise(known)
    columns = ["variant_rowid", "sample_id", *[allele(i).alias(f"GT{i + 1}") for i in range(ploidy)], F.when(gt.isNotNull(), phased).cast("bigint").alias("GT_ploidy")]
    columns += [_typed(F.element_at("_values", f["ID"]), f["Number"], f["Type"], one_or_list=True).alias(_column_name(f)) for f in formats if f["ID"] != "GT"]
    return Vcf(variants, samples, entry.select(*columns), refseqs)


def read_vcf_lines(spark: SparkSession, path: str, gri: bool = True) -> DataFrame:
    """(CHROM, POS zero-based, rlen, line); the header is one row with null coordinates."""
    lines = text_lines(spark, path)
    head = "\n".join(header_lines(spark, path, "#"))
    body = lines.filter(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t"))
    bad = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), "line")).cast("bigint")
    pos = F.when(F.size("f") < 8, bad("fewer than 8 fields")).otherwise(F.get("f", F.lit(1)).cast("bigint"))
    pos = F.when(pos < 1, bad("POS below 1")).otherwise(pos - 1)
    body = body.withColumn("POS", pos)
    end = F.regexp_extract(F.get("f", F.lit(7)), r"(?:^|;)END=(\d+)", 1).try_cast("bigint")
    rlen = F.when(end.isNull(), F.length(F.get("f", F.lit(3))).cast("bigint")).when(end < F.col("POS"), bad("END before POS")).otherwise(end - F.col("POS"))
    rows = body.select(F.get("f", F.lit(0)).alias("CHROM"), "POS", rlen.alias("rlen"), "line")
    first = spark.createDataFrame([(None, None, None, head)], rows.schema)
    rows = rows.unionByName(first)
    return with_range_columns(rows, F.col("CHROM"), F.col("POS"), F.col("POS") + F.col("rlen")) if gri else rows

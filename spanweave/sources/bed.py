"""Tab-separated feature text: sequence, start, end, name, score, strand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chrom string, beg bigint, end bigint, name string, score string, strand string"


def read_bed(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    """Rows (chrom, beg, end, name, score, strand); `one_based` starts are brought to zero."""
    rows = spark.read.csv(path, sep="\t", schema=SCHEMA, comment="#")
    return rows.withColumn("beg", F.col("beg") - 1) if one_based else rows

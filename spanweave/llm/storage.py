"""How the operators read their inputs, and small helpers; intermediate tables are those of plans.staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import discard, shared_dir, staged

__all__ = ["crc_mod", "discard", "hash_sample", "shared_dir", "staged", "table", "tokenizer_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of `doc_id`, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """`df` if it has at most `most` rows, else about 95 % of `most` rows: those with the lowest hashes of `key`.

    The cut follows from the row count, so nothing is sorted or gathered.
    """
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(0.95 * most / n * (1 << 30)))


def tokenizer_path(name: str, folder: str = "/opt/tokenizers") -> str:
    """A public tokenizer's vocabulary file; `folder` is where the installation keeps them."""
    return f"{folder}/{name}"

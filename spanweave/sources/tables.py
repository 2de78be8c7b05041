"""The tables that a reader gives, as views or on disk."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators.intervals import GRI_COLUMNS
from ..plans import layout


def _named(tables: NamedTuple, prefix: str) -> dict[str, DataFrame]:
    return {prefix + name: df for name, df in tables._asdict().items() if df is not None}


def create_views(tables: NamedTuple, prefix: str = "") -> list[str]:
    """Temporary views `prefix`name of the tables of read_vcf or read_sam; their names."""
    named = _named(tables, prefix)
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return list(named)


def write_tables(tables: NamedTuple, folder: str, prefix: str = "", by: dict[str, list[str]] | None = None, named: dict[str, list[str]] | None = None) -> list[str]:
    """Writes the tables to `folder`/`prefix`name.parquet; their names.

    Tables with range columns are laid out for lookups.  `by` names columns to
    order a table by, such as {"seqs": ["qname"]}: a row group's statistics then
    find a read by its name.  `named` names columns that a table has Bloom
    filters of, such as {"seqs": ["qname"]}: a row is then found by its name
    in a table that is ordered by something else, reading the row groups that may hold it.
    """
    blooms = named or {}
    found = _named(tables, prefix)
    for name, df in found.items():
        plain = name.removeprefix(prefix)
        path, order, options = f"{folder.rstrip('/')}/{name}.parquet", (by or {}).get(plain), layout.bloom_options(blooms.get(plain, ()))
        if order:
            df.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**options).option("compression", "zstd").parquet(path)
        elif set(GRI_COLUMNS) <= set(df.columns):
            layout.write_indexed(df, path, options=options)
        else:
            df.write.options(**options).option("compression", "zstd").parquet(path)
    return list(found)


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in names}

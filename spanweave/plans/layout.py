"""Physical layouts of feature tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import BEG, LEN, LVL, RID, TOP, Levels
from .staging import staged

#: The partition of a level in the path of a file; rows without a level lie in one that has no number.
_LEVEL = re.compile(rf"/{LVL}=(-?\d+)/")


def bloom_options(columns: Iterable[str]) -> dict[str, str]:
    """Parquet options for Bloom filters of columns, of a size that suits each row group's values."""
    found = {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
    return found and found | {"parquet.bloom.filter.adaptive.enabled": "true"}


def write_indexed(indexed: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists", options: Mapping[str, str] | None = None) -> None:
    """Writes a table with range columns so that lookups prune.

    Levels become partitions; within them files hold ranges of (sequence,
    begin) in order, so row-group statistics cut a lookup to few row groups.
    """
    by = (F.col(LVL), F.col(RID), F.col(BEG), F.col(LEN))
    dealt = indexed.repartitionByRange(partitions, *by) if partitions else indexed.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode(mode).options(**options or {}).partitionBy(LVL).option("compression", "zstd").parquet(path)


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """A table of `write_indexed`, with the levels in use as it then is.

    They are told by the partitions that have files, which Spark lists when it
    plans the read, so a lookup on the table runs no job to find them.  They
    belong to this DataFrame alone: what is appended later is seen by reading
    anew, and a DataFrame made from it scans for its levels.
    """
    table = spark.read.parquet(path)
    found = {int(x) for x in _LEVEL.findall("\n".join(table.inputFiles()))} if LVL in table.columns else set()
    table._levels_in_use = Levels(-min(found), -max(found)) if found else Levels(TOP, 0)
    return table


def compact(spark: SparkSession, source: str, target: str, order: list[str] | None = None, partitions: int | None = None, compression: str = "zstd", level: int | None = None) -> None:
    """Rewrites a Parquet table densely, in the order of `order` where given."""
    df = spark.read.parquet(source)
    if order:
        df = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    elif partitions:
        df = df.repartition(partitions)
    writer = df.write.mode("errorifexists").option("compression", compression)
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    writer.parquet(target)


def with_rowids(df: DataFrame, *order: str, name: str = "_rowid_") -> DataFrame:
    """Row ids from 1 in the order of `order` (as the rows lie without one), without bringing all rows together.

    Rows are dealt out by range of the order, numbered within their partition
    and staged with those numbers, so that they hold whatever is read later; the
    counts of earlier partitions (one row each) give each partition's offset.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    numbered = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "rowids")
    part, within = F.expr("shiftright(_at, 33)"), F.expr(f"_at & {(1 << 33) - 1}")
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    met = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row for each partition of the write
    return met.withColumn(name, within + F.col("_before") + 1).select(*df.columns, name)

"""Intermediate tables in the folder that driver and executors share.

They go to the folder that the cluster names in ``spark.checkpoint.dir``, so a
lost executor costs no recomputation beyond the current stage.  Only where a
session names none and its master is local (tests, a laptop) a local folder is
made up.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set to a new local one only if unset, and only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanweave-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


class scope:  # noqa: N801
    """What is staged within the block is deleted at its end, but for what `keep` is given.

    For callers that know when they are done with a result::

        with scope():
            range_join(reads, features, how="left").write.parquet(target)
    """

    _open: list[scope] = []

    def __enter__(self) -> scope:
        self.tables: list[DataFrame] = []
        scope._open.append(self)
        return self

    def keep(self, rows: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not rows]
        return rows

    def __exit__(self, *_) -> None:
        scope._open.remove(self)
        for rows in self.tables:
            discard(rows)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._staged_at = path
    if scope._open:
        scope._open[-1].tables.append(rows)
    return rows


def discard(rows: DataFrame) -> None:
    """Deletes the table behind what staged() returned, once everything made from it is written."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(rows._staged_at)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

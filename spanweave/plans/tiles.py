"""Tables of ranges laid out in tiles, so that joins of two of them shuffle neither.

A tile is a stretch of (sequence, begin) that holds about as many features as
any other, whatever place they crowd at; tiles are cut once, from one table,
and kept beside it.  A row lies in the tile that it begins in, and a copy of
it in each later one that it reaches into.  Tables are bucketed by tile, so an
overlap join of two tables with the same tiles joins bucket with bucket where
they lie.  Of a pair one row at least begins in the tile where the later of
the two begins, and there alone, so leaving out pairs of two copies gives each
pair once.

A row that reaches over many tiles is stored as often.  In a tile that it
reaches into it overlaps all that is open at the tile's start, so its copies
don't outgrow the pairs that joins of such tables give.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overlap_join import hashable

#: Rows that a tile holds about, and the tiles of a table at most (besides one for each task of the sort); their starts are sent to all tasks.
TILE_ROWS, MOST_TILES = 512, 1 << 17
#: Files that the tiles are dealt to by default.
BUCKETS = 64
#: Tiles for rows whose sequence has none, and for rows without a range, which meet nothing.
_STRANGE, _VOID = 1024, 4096
#: What a table says of itself: where its tiles are, how many rows are stored in how many buckets.
_PROPERTY, _ROWS, _FILES = "spanweave.tiles", "spanweave.rows", "spanweave.buckets"
_TILE, _COPY, _BOUNDS = "_tile", "_copy", ("_tile_rid", "_tile_beg", "_tile_end")


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def cut_tiles(df: DataFrame, rid: Column | str, beg: Column | str, rows: int = TILE_ROWS) -> DataFrame:
    """Rows (rid, beg): where the tiles start that suit `df`."""
    begins = df.select(_column(rid).cast("string").alias("rid"), _column(beg).cast("long").alias("beg")).dropna()
    size = max(rows, -(-begins.count() // MOST_TILES))
    in_order = begins.repartitionByRange("rid", "beg").sortWithinPartitions("rid", "beg")
    # The low bits of this id are a row's place in its partition.
    return in_order.withColumn("at", F.monotonically_increasing_id()).filter(F.expr(f"(at & {(1 << 33) - 1}) % {size} = 0")).select("rid", "beg").distinct()


class Tiles:
    """Numbers of tiles by sequence and position."""

    def __init__(self, starts: list[tuple[str, int]]):
        runs: dict[str, list[int]] = {}
        for rid, beg in sorted(starts):
            runs.setdefault(rid, []).append(beg)
        self.runs, first = {}, 0
        for rid, begins in runs.items():
            self.runs[rid] = (first, np.array(begins, dtype=np.int64))
            first += len(begins)

    def of(self, rids: pd.Series, positions: np.ndarray) -> np.ndarray:
        """The last tile of the sequence that starts up to a position, or its first."""
        out = np.zeros(len(rids), dtype=np.int64)
        codes, names = pd.factorize(rids)
        for k, rid in enumerate(names):
            rows = codes == k
            first, begins = self.runs.get(rid, (-1 - sum(rid.encode()) % _STRANGE, np.zeros(0, np.int64)))
            out[rows] = first + np.maximum(np.searchsorted(begins, positions[rows], "right") - 1, 0)
        return out


def write_tiled(df: DataFrame, table: str, path: str, range_: Sequence[Column | str], tiles: str | None = None, buckets: int = BUCKETS) -> str:
    """Writes `df` as a bucketed table whose ranges are the columns or expressions `range_` (sequence, begin, end).

    `tiles` is what an earlier call returned for the table that this one is to
    be joined with; without it tiles are cut for this one.  Returns where they
    are kept.  Rows without a range are kept and meet nothing; those that end
    before they begin meet what holds both their points.
    """
    spark = df.sparkSession
    if tiles is None:
        tiles = f"{path.rstrip('/')}_tiles"
        cut_tiles(df, *range_[:2]).coalesce(1).write.parquet(tiles)
    # MOST_TILES rows of a name and a number at most, and one for each task of the sort.
    starts = spark.sparkContext.broadcast(Tiles([tuple(r) for r in spark.read.parquet(tiles).select("rid", "beg").collect()]))

    @F.pandas_udf("first long, last long")
    def reach(rid: pd.Series, beg: pd.Series, end: pd.Series) -> pd.DataFrame:
        whole = (rid.notna() & beg.notna() & end.notna()).to_numpy()
        low, high = beg.fillna(0).to_numpy(np.int64), end.fillna(0).to_numpy(np.int64)
        names = rid.where(whole, "")
        first = starts.value.of(names, np.minimum(low, high))
        last = np.where(high < low, first, starts.value.of(names, high))
        return pd.DataFrame({"first": pd.Series(first).where(whole), "last": pd.Series(last).where(whole)}).astype("Int64")

    rid, beg, end = map(_column, range_)
    rows = df.withColumns(dict(zip(_BOUNDS, (rid.cast("string"), beg.cast("long"), end.cast("long")), strict=True)))
    void = -1 - _STRANGE - F.pmod(F.monotonically_increasing_id(), F.lit(_VOID))
    rows = rows.withColumn("_void", void).withColumn("_reach", reach(*map(F.col, _BOUNDS))).withColumn("_first", F.coalesce("_reach.first", "_void"))
    rows = rows.withColumn(_TILE, F.explode(F.sequence("_first", F.coalesce("_reach.last", "_first")))).withColumn(_COPY, F.col(_TILE) > F.col("_first")).drop("_reach", "_first", "_void")
    rows.repartition(buckets, _TILE).write.mode("errorifexists").bucketBy(buckets, _TILE).sortBy(_TILE).option("path", path).option("compression", "zstd").saveAsTable(table)
    stored = spark.table(table).count()  # from the files' footers
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_PROPERTY}' = '{tiles}', '{_ROWS}' = '{stored}', '{_FILES}' = '{buckets}')")
    return tiles


def read_tiled(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a tiled table, each once."""
    return spark.table(table).filter(~F.col(_COPY)).drop(_TILE, _COPY, *_BOUNDS)


def _said(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def tiled_join(spark: SparkSession, left: str, right: str, residual: Column | str | None = None, suffix: str = "_f") -> DataFrame:
    """The overlapping pairs of ranges of `left` and features of `right`, tables of the same tiles, each once, without a shuffle of either.

    Columns of `right` that clash with those of `left` get `suffix`.
    """
    said, said_right = _said(spark, left), _said(spark, right)
    if said[_PROPERTY] != said_right[_PROPERTY]:
        raise ValueError(f"{left} and {right} are laid out in different tiles: write one for the tiles of the other")
    a, b = spark.table(left), spark.table(right)
    hidden = {c: f"{c}_b" for c in (_TILE, _COPY, *_BOUNDS)}
    b = b.withColumnsRenamed({c: c + suffix for c in b.columns if c in a.columns and c not in hidden} | hidden)
    (rid, beg, end), (rid_b, beg_b, end_b) = map(F.col, _BOUNDS), (F.col(hidden[c]) for c in _BOUNDS)
    # The tile alone is the key, as the tables are bucketed; sequences that share one are told apart by two comparisons, which are no key.
    met = (F.col(_TILE) == F.col(hidden[_TILE])) & (beg_b <= end_b) & (rid <= rid_b) & (rid >= rid_b) & (beg_b <= end) & (end_b >= beg) & ~(F.col(_COPY) & F.col(hidden[_COPY]))
    if hashable(spark, int(said_right[_ROWS]), int(said_right[_FILES])):
        b = b.hint("shuffle_hash")
    joined = a.join(b, met if residual is None else met & _column(residual))
    return joined.drop(*hidden, *hidden.values())

"""Genomic-range columns, lookups and their SQL text.

A feature is a row with a sequence id, a begin and an end.  Its level is the
smallest L with end - begin <= 16**L; features of null or negative length, or
longer than 16**15, have no level and never match.  A feature overlaps a
range if neither ends before the other begins; touching counts.

On a table laid out by `plans.layout.write_indexed` the predicate of a lookup
prunes partitions by level and row groups by begin.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOP = 15
LONGEST = 16**TOP
#: A lookup names the reach of each level up to so many levels.
MAX_SPELLED_LEVELS = 6
RID, BEG, LEN, LVL = "_gri_rid", "_gri_beg", "_gri_len", "_gri_lvl"
GRI_COLUMNS = (RID, BEG, LEN, LVL)


class Levels(NamedTuple):
    """The highest and lowest occupied level."""

    ceiling: int
    floor: int


def _as_column(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.expr(x) if isinstance(x, str) else F.lit(x)


def check_bounds(ceiling: int, floor: int) -> None:
    if not 0 <= floor <= ceiling <= TOP:
        raise ValueError(f"levels must satisfy 0 <= floor <= ceiling <= {TOP}, not floor={floor}, ceiling={ceiling}")


def level_of(length: Column, floor: int = 0) -> Column:
    """The positive level of a length, null if it has none."""
    check_bounds(TOP, floor)
    found = F.when(length < 0, F.lit(None).cast("int"))
    for level in range(floor, TOP + 1):
        found = found.when(length <= F.lit(16**level).cast("long"), F.lit(level))
    return found


def with_range_columns(df: DataFrame, rid: Column | str, beg: Column | str, end: Column | str, floor: int | None = None) -> DataFrame:
    """Adds _gri_rid, _gri_beg, _gri_len and _gri_lvl (the level's negative) to `df`.

    The arguments are columns or SQL expressions.  Levels below `floor` are
    lumped into it; -1 and None mean 0.
    """
    floor = 0 if floor is None or floor == -1 else floor
    begin = _as_column(beg).cast("long")
    length = _as_column(end).cast("long") - begin
    return df.withColumns({RID: _as_column(rid), BEG: begin, LEN: length, LVL: -level_of(length, floor)})


def occupied_levels(indexed: DataFrame) -> DataFrame:
    """One row (_gri_ceiling, _gri_floor): the levels in use; (15, 0) if none are."""
    used = indexed.filter(F.col(RID).isNotNull() & F.col(LVL).isNotNull())
    return used.agg(F.coalesce(F.max(-F.col(LVL)), F.lit(TOP)).cast("int").alias("_gri_ceiling"), F.coalesce(F.min(-F.col(LVL)), F.lit(0)).cast("int").alias("_gri_floor"))


def detect_levels(indexed: DataFrame) -> Levels:
    """The levels in use: as `plans.layout.read_indexed` found them, else by a scan."""
    known = getattr(indexed, "_levels_in_use", None)
    if known is not None:
        return known
    row = occupied_levels(indexed).first()
    return Levels(row["_gri_ceiling"], row["_gri_floor"])


def level_predicate(level: int, qrid: Column, qbeg: Column, qend: Column) -> Column:
    """Features of one level that overlap: their begin can lie at most 16**level before the range."""
    beg = F.col(BEG)
    return (F.col(LVL) == -level) & (F.col(RID) == qrid) & (beg >= qbeg - F.lit(16**level).cast("long")) & (beg <= qend) & (beg + F.col(LEN) >= qbeg)


def overlaps(qrid: Column | str | int, qbeg: Column | str | int, qend: Column | str | int, ceiling: int = TOP, floor: int = 0) -> Column:
    """Whether a feature overlaps the range and its level lies within the bounds (bounds decide results)."""
    check_bounds(ceiling, floor)
    rid = F.lit(qrid) if not isinstance(qrid, Column) else qrid
    begin, end = (F.lit(x).cast("long") if not isinstance(x, Column) else x for x in (qbeg, qend))
    if ceiling - floor >= MAX_SPELLED_LEVELS:
        # Over many levels the reach of the highest decides; the predicate stays short enough to compile, and with a
        # begin bound on both sides row groups are pruned on both.
        inside = (F.col(RID) == rid) & (F.col(BEG) >= begin - F.lit(16**ceiling).cast("long")) & (F.col(BEG) <= end) & (F.col(BEG) + F.col(LEN) >= begin)
        # Without a lower bound on levels the length says the same as the level, and needs no level worked out.
        return inside & (F.col(LEN).between(0, 16**ceiling) if floor == 0 else F.col(LVL).between(-ceiling, -floor))
    found = F.lit(False)
    for level in range(floor, ceiling + 1):
        found = found | level_predicate(level, rid, begin, end)
    return found


def lookup(indexed: DataFrame, qrid, qbeg, qend, ceiling: int | None = None, floor: int | None = None) -> DataFrame:
    """The rows of `indexed` that overlap one range.

    Without a ceiling the levels in use are looked up first, so the predicate
    names no more levels than occur; a table of `plans.layout.read_indexed`
    knows them without a job.
    """
    if ceiling is None or ceiling < 0:
        used = detect_levels(indexed)
        ceiling, floor = used.ceiling, used.floor if floor is None or floor < 0 else floor
        floor = min(floor, ceiling)
    return indexed.filter(overlaps(qrid, qbeg, qend, ceiling, max(floor or 0, 0)))


def contained(qbeg: Column | int, qend: Column | int) -> Column:
    """Features that lie within the range."""
    return (F.col(BEG) >= qbeg) & (F.col(BEG) + F.col(LEN) <= qend)


def strictly_overlaps(qbeg: Column | int, qend: Column | int) -> Column:
    """Leaves out features that only touch the range."""
    return (F.col(BEG) < qend) & (F.col(BEG) + F.col(LEN) > qbeg)


def in_genomic_order(indexed: DataFrame) -> DataFrame:
    return indexed.orderBy(RID, BEG, LEN)


def circular_lookup(indexed: DataFrame, qrid, qbeg: int, qend: int, sequence_length: int, ceiling: int = TOP, floor: int = 0) -> DataFrame:
    """Also finds features that run past the origin of a circular sequence into the range; each once."""
    return indexed.filter(overlaps(qrid, qbeg, qend, ceiling, floor) | overlaps(qrid, sequence_length + qbeg, sequence_length + qend, ceiling, floor))


def scan_from_first(indexed: DataFrame, qrid, qbeg: int, qend: int, rowid: str = "_rowid_") -> DataFrame:
    """For tables in genomic order: all rows from the first overlapping one on."""
    first = indexed.filter(overlaps(qrid, qbeg, qend)).agg(F.min(rowid).alias("_first"))
    return indexed.join(F.broadcast(first), F.col(rowid) >= F.col("_first")).drop("_first")  # one row


def rowids(indexed: DataFrame, qrid, qbeg, qend, ceiling: int = TOP, floor: int = 0, rowid: str = "_rowid_") -> DataFrame:
    """The ids of overlapping rows in ascending order."""
    return indexed.filter(overlaps(qrid, qbeg, qend, ceiling, floor)).select(rowid).orderBy(rowid)


def rowids_sql(table: str, qrid: str = ":qrid", qbeg: str = ":qbeg", qend: str = ":qend", ceiling: int = -1, floor: int = -1, spark: SparkSession | None = None, rowid: str = "_rowid_") -> str:
    """A parenthesised SELECT of overlapping row ids, to paste into a query.

    The range is given as parameters, literals or expressions.  With a
    negative ceiling, the levels in use are detected (this takes a session);
    with a ceiling and a negative floor, the floor is 0.
    """
    if ceiling < 0:
        session = spark or SparkSession.getActiveSession()
        used = detect_levels(session.table(table))
        ceiling, floor = used.ceiling, used.floor if floor < 0 else floor
    floor = max(floor, 0)
    check_bounds(ceiling, floor)
    levels = "\n    OR ".join(f"({LVL} = {-level} AND {BEG} >= ({qbeg}) - {16**level}L AND {BEG} <= ({qend}) AND {BEG} + {LEN} >= ({qbeg}))" for level in range(floor, ceiling + 1))
    return f"(SELECT {rowid} FROM {table}\n WHERE {RID} = ({qrid}) AND (\n    {levels})\n ORDER BY {rowid})"


def register_lookup(spark: SparkSession, name: str, table: str, rid_type: str = "STRING", ceiling: int = TOP, floor: int = 0, rowid: str = "_rowid_") -> None:
    """A SQL table function `name`(rid, beg, end[, ceiling[, floor]]) of the overlapping row ids of an indexed view or table.

    `ceiling` and `floor` are what a call without them gets.
    """
    missing = set(GRI_COLUMNS) | {rowid}
    missing -= set(spark.table(table).columns)
    if missing:
        raise ValueError(f"{table} lacks {', '.join(sorted(missing))}: add them with with_range_columns()")
    check_bounds(ceiling, floor)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(qrid {rid_type}, qbeg BIGINT, qend BIGINT, ceiling INT DEFAULT {ceiling}, floor INT DEFAULT {floor}) RETURNS TABLE({rowid} BIGINT)
      RETURN SELECT t.{rowid} FROM {table} t
      WHERE t.{LVL} >= -CASE WHEN {name}.floor BETWEEN 0 AND {name}.ceiling AND {name}.ceiling <= {TOP} THEN {name}.ceiling ELSE CAST(raise_error('levels must satisfy 0 <= floor <= ceiling <= {TOP}') AS INT) END
      AND t.{LVL} <= -{name}.floor AND t.{RID} = {name}.qrid
      AND t.{BEG} >= {name}.qbeg - shiftleft(1L, 4 * {name}.ceiling) AND t.{BEG} <= {name}.qend AND t.{BEG} + t.{LEN} >= {name}.qbeg""")


def register_levels(spark: SparkSession, name: str, table: str) -> None:
    """A SQL table function `name`() of one row: the highest and the lowest level in use."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE(_gri_ceiling INT, _gri_floor INT)
      RETURN SELECT coalesce(max(-{LVL}), {TOP}), coalesce(min(-{LVL}), 0) FROM {table} WHERE {RID} IS NOT NULL AND {LVL} IS NOT NULL""")


def range_columns_sql(table: str, rid: str, beg: str, end: str, floor: int | None = None) -> str:
    """SQL text of a SELECT of `table` with the range columns."""
    floor = 0 if floor is None or floor == -1 else floor
    check_bounds(TOP, floor)
    whens = " ".join(f"WHEN ({end}) - ({beg}) <= {16**level}L THEN {-level}" for level in range(floor, TOP + 1))
    return f"SELECT *, {rid} AS {RID}, CAST({beg} AS BIGINT) AS {BEG}, CAST(({end}) - ({beg}) AS BIGINT) AS {LEN}, CASE WHEN ({end}) - ({beg}) < 0 THEN NULL {whens} END AS {LVL} FROM {table}"

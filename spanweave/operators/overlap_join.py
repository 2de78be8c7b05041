"""Overlap joins of ranges with features.

Small feature tables are broadcast and joined on the sequence id, with the
overlap as residual.  Others meet on hierarchical bins: a feature of level L
and a range of level Q share a bin of width 16**max(L, Q), in which the
feature begins and of which the range needs three at most; every overlapping
pair meets exactly once, so nothing is deduplicated.  A bin is part of the
join key together with the sequence id, so one sequence that holds most rows
is spread over many tasks.

Left, semi and anti joins give each range one place, so that they are joins of
just their kind and no pair is dealt after it is made.  The place is the
stretch of (sequence, level of the range) that the range ends in; stretches
hold about as many ranges each, and a feature goes to all from its begin to as
far behind its end as the longest range of that level reaches.  A feature that
spans a stretch meets all its ranges, so copies stay behind pairs; where they
outgrow the features all the same, stretches are made longer.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .intervals import LONGEST, TOP, level_of

#: Features that are broadcast at most; at three columns' width about 4 MB.
BROADCAST_ROWS = 50_000
#: Pairs of a range and a feature on one sequence that broadcasting may examine at most, per range.
BROADCAST_PER_SEQUENCE = 5_000
#: A side whose share of a partition is at most this large may be hashed in memory, which a join of many candidates a key gains by.
HASHED_BYTES = 64 << 20
#: What a row of bounds and a few columns takes in a hash table.
_ROW_BYTES = 160
#: Ranges that a stretch holds about, and the stretches at most; their starts are sent to all tasks.
STRETCH_RANGES, MOST_STRETCHES = 32, 1 << 20
#: Copies of a feature in further stretches, in the mean at most.
MOST_COPIES = 3
#: Ranges with a null meet nothing and are dealt to so many places.
_VOID = 4096
_LAST = (1 << 63) - 1
KINDS = ("inner", "left", "left_semi", "left_anti")
_ARGS = ("_q_rid", "_q_beg", "_q_end"), ("_f_rid", "_f_beg", "_f_end")


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _prepared(df: DataFrame, names: tuple[str, str, str], exprs: Sequence[Column | str]) -> DataFrame:
    rid, beg, end = map(_column, exprs)
    return df.withColumns({names[0]: rid, names[1]: beg.cast("long"), names[2]: end.cast("long")})


def _feature_level(floor: int) -> Column:
    return level_of(F.col("_f_end") - F.col("_f_beg"), floor)


def _query_level() -> Column:
    length = F.least(F.greatest(F.col("_q_end") - F.col("_q_beg"), F.lit(0)), F.lit(LONGEST).cast("long"))
    return level_of(length)


def _overlap() -> Column:
    return (F.col("_f_beg") <= F.col("_q_end")) & (F.col("_f_end") >= F.col("_q_beg"))


def _binned_features(features: DataFrame, query_levels: list[int]) -> DataFrame:
    widths = F.array_distinct(F.transform(F.array(*[F.lit(q) for q in query_levels]), lambda q: F.greatest(q, F.col("_level"))))
    rows = features.withColumn("_width", F.explode(widths))
    return rows.withColumn("_bin", F.call_function("shiftright", F.col("_f_beg"), F.col("_width") * 4))


def _binned_queries(queries: DataFrame, feature_levels: list[int]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(16**level).cast("long").alias("reach")) for level in feature_levels])
    rows = queries.withColumn("_step", F.explode(steps)).withColumn("_width", F.greatest("_step.level", "_q_level"))
    low = F.call_function("shiftright", F.col("_q_beg") - F.col("_step.reach"), F.col("_width") * 4)
    high = F.greatest(F.call_function("shiftright", F.col("_q_end"), F.col("_width") * 4), low)
    return rows.withColumn("_bin", F.explode(F.sequence(low, high))).withColumn("_level", F.col("_step.level")).drop("_step")


def _occupied(df: DataFrame, level: str, rid: str) -> tuple[list[int], int, int]:
    """Levels in use, rows, and rows of the largest sequence: one aggregate with a row for each level."""
    rows = df.groupBy(rid, level).agg(F.count(F.lit(1)).alias("n")).groupBy(level).agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    return sorted(r[level] for r in rows), sum(r["n"] for r in rows), sum(r["most"] for r in rows)


def range_join(
    queries: DataFrame,
    features: DataFrame,
    query: Sequence[Column | str] = ("rid", "beg", "end"),
    feature: Sequence[Column | str] = ("rid", "beg", "end"),
    how: str = "inner",
    residual: Column | str | None = None,
    floor: int = 0,
    ceiling: int = TOP,
    suffix: str = "_f",
    strategy: str = "auto",
) -> DataFrame:
    """Joins each range of `queries` with the features that it overlaps.

    Columns of `features` that clash with those of `queries` get `suffix`.
    `residual` is a further condition, part of the join: a row of a left join
    without a partner that meets it is kept once.  `strategy` is "auto",
    "broadcast" or "bins".
    """
    if how not in KINDS:
        raise ValueError(f"how must be one of {KINDS}")
    taken = set(queries.columns)
    features = features.withColumnsRenamed({c: c + suffix for c in features.columns if c in taken and not (suffix == "")})
    renamed = [(_rename(x, taken, suffix)) for x in feature]
    left = _prepared(queries, _ARGS[0], query)
    right = _prepared(features, _ARGS[1], renamed).withColumn("_level", _feature_level(floor))
    right = right.filter(F.col("_f_rid").isNotNull() & F.col("_level").between(floor, ceiling))
    extra = F.lit(True) if residual is None else _column(residual)
    feature_levels, rows, per_sequence = _occupied(right, "_level", "_f_rid")
    if strategy == "broadcast" or strategy == "auto" and rows <= BROADCAST_ROWS and per_sequence <= BROADCAST_PER_SEQUENCE:
        condition = (F.col("_q_rid") == F.col("_f_rid")) & _overlap() & extra
        joined = left.join(F.broadcast(right), condition, how)
        return joined.drop(*_ARGS[0], *_ARGS[1], "_level")
    if how == "inner":
        return _binned(left, right, feature_levels, extra, rows).select(*queries.columns, *features.columns)
    joined = _placed(left, right, extra, rows, how)
    return joined.select(*queries.columns) if how in ("left_semi", "left_anti") else joined.select(*queries.columns, *features.columns)


def _starts_of(drawn: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Where the stretches of each sequence and level of ranges start, from ends (rid, level, end) drawn among all."""
    runs = {}
    for rid, level, found in drawn.groupBy("rid", "level").agg(F.collect_list("end")).toLocalIterator():
        starts, times = np.unique(np.array(found, dtype=np.int64), return_counts=True)
        # A place that many ranges end at is a stretch of its own.
        runs[rid, level] = np.union1d(starts, starts[(times > 1) & (starts < _LAST)] + 1)
    return runs


def _places(sent):
    """How tasks number stretches; 0 is what lies before the first start."""

    def place(rids: pd.Series, levels: pd.Series, positions: pd.Series) -> pd.Series:
        out, at = np.zeros(len(rids), dtype=np.int64), positions.to_numpy()
        for run, rows in pd.DataFrame({"rid": rids.to_numpy(), "level": levels.to_numpy()}).groupby(["rid", "level"]).indices.items():
            if run in sent.value:
                out[rows] = np.searchsorted(sent.value[run], at[rows], "right")
        return pd.Series(out)

    return F.pandas_udf(place, "long")


def _places_of_features(features: DataFrame, place, reaches: Mapping[int, int]) -> DataFrame:
    """Each feature once for each level of ranges, with its first and last stretch there."""
    levels = [F.struct(F.lit(level).alias("level"), F.lit(reach).cast("long").alias("reach")) for level, reach in reaches.items()]
    rows = features.withColumn("_of", F.explode(F.array(*levels)))
    beyond = F.when(F.col("_f_end") > F.lit(_LAST) - F.col("_of.reach"), F.lit(_LAST)).otherwise(F.col("_f_end") + F.col("_of.reach"))
    rid = F.col("_f_rid").cast("string")
    return rows.withColumns({"_first": place(rid, F.col("_of.level"), F.col("_f_beg")), "_last": place(rid, F.col("_of.level"), beyond), "_place_level_f": F.col("_of.level")}).drop("_of", "_level")


def _placed(queries: DataFrame, features: DataFrame, extra: Column, feature_rows: int, how: str) -> DataFrame:
    """A left, semi or anti join of prepared ranges and features, each range at one place."""
    spark = queries.sparkSession
    whole = F.col("_q_rid").isNotNull() & F.col("_q_beg").isNotNull() & F.col("_q_end").isNotNull()
    ranges = queries.withColumn("_place_level", F.when(whole, _query_level()))
    sound = ranges.filter("_place_level is not null")
    length = F.greatest(F.col("_q_end") - F.col("_q_beg"), F.lit(0))
    levels = sound.groupBy("_place_level").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("reach")).collect()
    if not feature_rows or not levels:
        return queries.join(features.filter(F.lit(False)), F.col("_q_rid") == F.col("_f_rid"), how)
    size = max(STRETCH_RANGES, -(-sum(r["n"] for r in levels) // MOST_STRETCHES))
    # Where stretches start decides about speed alone, but equal names must read alike.
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "_q_rid"), (features, "_f_rid"))]
    alike = kinds[0] == kinds[1] and not re.search("float|double|collate", kinds[0])
    drawn = sound.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(size)) == 0)
    starts = _starts_of(drawn.select(F.col("_q_rid").cast("string").alias("rid"), F.col("_place_level").alias("level"), F.col("_q_end").alias("end"))) if alike else {}
    reaches = {r["_place_level"]: r["reach"] for r in levels}
    place = _places(spark.sparkContext.broadcast(starts))
    copies = _places_of_features(features.select("_f_rid", "_f_beg", "_f_end", "_level"), place, reaches).agg(F.sum(F.col("_last") - F.col("_first"))).first()[0]
    times, held = 1, feature_rows * len(levels)
    while copies > MOST_COPIES * held * times:
        times *= 2
    if times > 1:
        place = _places(spark.sparkContext.broadcast({run: found[::times] for run, found in starts.items()}))
    void = F.pmod(F.monotonically_increasing_id(), F.lit(_VOID))
    own = place(F.coalesce(F.col("_q_rid").cast("string"), F.lit("")), F.coalesce("_place_level", F.lit(-1)), F.coalesce("_q_end", F.lit(0).cast("long")))
    a = ranges.withColumn("_place", F.when(F.col("_place_level").isNull(), void).otherwise(own))
    b = _places_of_features(features, place, reaches).withColumn("_place_f", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    if hashable(spark, held + copies // times, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        b = b.hint("shuffle_hash")
    same = (F.col("_q_rid") == F.col("_f_rid")) & (F.col("_place_level") == F.col("_place_level_f")) & (F.col("_place") == F.col("_place_f"))
    return a.join(b, same & _overlap() & extra, how)


def hashable(spark: SparkSession, rows: int, parts: int) -> bool:
    """Whether so many rows over so many partitions may be hashed: their share is small, and skewed shares are split at run time."""
    return rows * _ROW_BYTES <= HASHED_BYTES * parts and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def _binned(queries: DataFrame, features: DataFrame, feature_levels: list[int], extra: Column, feature_rows: int) -> DataFrame:
    """The overlapping pairs of prepared ranges and features, each once.

    A bin's candidates are tried pair by pair, which a hash join does several
    times faster than a merge join; it is asked for where the features'
    share of a partition is known to be small.
    """
    sound = queries.filter(F.col("_q_rid").isNotNull() & F.col("_q_beg").isNotNull() & F.col("_q_end").isNotNull()).withColumn("_q_level", _query_level())
    query_levels, _, _ = _occupied(sound, "_q_level", "_q_rid")
    if not feature_levels or not query_levels:
        return sound.join(features, F.col("_q_rid") == F.col("_f_rid")).filter(F.lit(False))
    a, b = _binned_queries(sound, feature_levels), _binned_features(features, query_levels)
    same = (F.col("_q_rid") == F.col("_f_rid")) & (F.col("a._level") == F.col("b._level")) & (F.col("a._width") == F.col("b._width")) & (F.col("a._bin") == F.col("b._bin"))
    spark = queries.sparkSession
    if hashable(spark, feature_rows * len(query_levels), int(spark.conf.get("spark.sql.shuffle.partitions"))):
        b = b.hint("shuffle_hash")
    return a.alias("a").join(b.alias("b"), same & _overlap() & extra)


def _rename(x: Column | str, taken: set[str], suffix: str) -> Column | str:
    """A plain column name follows its renaming; expressions must use the new names."""
    return x + suffix if isinstance(x, str) and x in taken else x

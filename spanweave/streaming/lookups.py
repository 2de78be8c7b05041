"""Range lookups of a stream against a static feature table.

The bins of an overlap join are plain equi keys, so a stream of ranges joins
a static table of features like any other stream-static join, without state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..operators import overlap_join as o


def stream_overlaps(stream: DataFrame, features: DataFrame, query: Sequence[Column | str] = ("rid", "beg", "end"), feature: Sequence[Column | str] = ("rid", "beg", "end"), floor: int = 0, query_levels: Sequence[int] = range(o.TOP + 1), suffix: str = "_f") -> DataFrame:
    """Each range of a streaming `stream` with the static features that it overlaps.

    The features' levels are looked up once; those of the stream can't be, so
    ranges of every level in `query_levels` are provided for.
    """
    taken = set(stream.columns)
    features = features.withColumnsRenamed({c: c + suffix for c in features.columns if c in taken})
    right = o._prepared(features, o._ARGS[1], [o._rename(x, taken, suffix) for x in feature]).withColumn("_level", o._feature_level(floor))
    right = right.filter("_f_rid is not null and _level is not null")
    levels, _, _ = o._occupied(right, "_level", "_f_rid")
    left = o._prepared(stream, o._ARGS[0], query).filter("_q_rid is not null and _q_beg is not null and _q_end is not null").withColumn("_q_level", o._query_level())
    a, b = o._binned_queries(left, levels or [0]).alias("a"), o._binned_features(right, list(query_levels)).alias("b")
    pairs = a.join(b, _condition())
    return pairs.select(*stream.columns, *features.columns)


def _condition() -> Column:
    from pyspark.sql import functions as F

    keys = ("_level", "_width", "_bin")
    same = F.col("_q_rid") == F.col("_f_rid")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return same & o._overlap()

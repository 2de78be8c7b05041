"""Overlap joins on circular sequences.

A sequence whose reference entry says ``{"circular": true}`` closes at its
length: a range or feature that ends beyond it goes on from the origin.  A
range on such a sequence is asked about as it is, one turn on and one turn
back; where it meets a feature at several turns the first of them counts, so
each pair comes once.  Turns that no feature of the sequence can reach are
left out before the join, and ranges on other sequences are joined as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from .overlap_join import KINDS, range_join

_RANGE, _FEATURE = ("_c_rid", "_c_beg", "_c_end"), ("_d_rid", "_d_beg", "_d_end")


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def circular_lengths(refseqs: DataFrame) -> DataFrame:
    """Rows (rid, length) of the circular sequences of a reference table."""
    circular = F.get_json_object("gri_refseq_meta_json", "$.circular") == "true"
    return refseqs.filter(circular & (F.col("gri_refseq_length") > 0)).select(F.col("_gri_rid").alias("_l_rid"), F.col("gri_refseq_length").alias("_length"))


def _turns(ranges: DataFrame, features: DataFrame, lengths: DataFrame) -> DataFrame:
    """(_q_id, bounds, _length, _turn, _at_beg, _at_end): each range at every turn that its sequence's features can reach."""
    reach = features.groupBy(F.col(_FEATURE[0]).alias("_l_rid")).agg(F.min(_FEATURE[1]).alias("_least"), F.max(_FEATURE[2]).alias("_most"))
    met = ranges.join(lengths.join(reach, "_l_rid"), F.col(_RANGE[0]) == F.col("_l_rid"), "left")
    shift = F.col("_t") * F.coalesce("_length", F.lit(0))
    turned = met.withColumn("_t", F.explode(F.when(F.col("_length").isNull(), F.array(F.lit(0))).otherwise(F.array(*[F.lit(t) for t in (0, 1, -1)]))))
    turned = turned.withColumns({"_at_beg": F.col(_RANGE[1]) + shift, "_at_end": F.col(_RANGE[2]) + shift})
    return turned.filter((F.col("_t") == 0) | (F.col("_at_beg") <= F.col("_most")) & (F.col("_at_end") >= F.col("_least"))).drop("_l_rid", "_least", "_most")


def circular_join(queries: DataFrame, features: DataFrame, refseqs: DataFrame, query: Sequence[Column | str] = ("rid", "beg", "end"), feature: Sequence[Column | str] = ("rid", "beg", "end"), how: str = "inner", suffix: str = "_f") -> DataFrame:
    """Joins each range with the features that it overlaps, also across the origin of circular sequences; sequences are named by id.

    Columns of `features` that clash with those of `queries` get `suffix`;
    `feature` names them as they are in `features`.
    """
    if how not in KINDS:
        raise ValueError(f"how must be one of {KINDS}")
    rid, beg, end = map(_column, query)
    named = queries.withColumns(dict(zip(_RANGE, (rid, beg.cast("long"), end.cast("long")), strict=True)))
    named = staged(named.withColumn("_q_id", F.monotonically_increasing_id()), "circular-queries")
    f_rid, f_beg, f_end = map(_column, feature)
    bounded = features.withColumns(dict(zip(_FEATURE, (f_rid, f_beg.cast("long"), f_end.cast("long")), strict=True)))
    bounded = bounded.withColumnsRenamed({c: c + suffix for c in features.columns if c in queries.columns})
    turned = _turns(named.select("_q_id", *_RANGE), bounded, circular_lengths(refseqs))
    first = F.lit(True)
    for turn, before in ((1, (0,)), (-1, (0, 1))):
        for t in before:
            low, high = (F.col(c) + t * F.coalesce("_length", F.lit(0)) for c in _RANGE[1:])
            first = first & ~((F.col("_t") == turn) & (F.col(_FEATURE[1]) <= high) & (F.col(_FEATURE[2]) >= low))
    pairs = range_join(turned, bounded, (_RANGE[0], "_at_beg", "_at_end"), _FEATURE, residual=first, suffix="")
    if how in ("left_semi", "left_anti"):
        return named.join(pairs.select("_q_id").distinct(), "_q_id", how).select(*queries.columns)
    taken = [c + suffix if c in queries.columns else c for c in features.columns]
    return named.join(pairs.select("_q_id", *taken), "_q_id", how).select(*queries.columns, *taken)

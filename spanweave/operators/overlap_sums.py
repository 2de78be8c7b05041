"""Counts and sums over overlaps, without listing a pair.

A range meets the features that begin up to its end, less those that end
before its begin (these begin before its end too).  So the sum of any measure
over the features that a range overlaps is a running sum over begins, read at
the range's end, less a running sum over ends, read at its begin.

Begins with the probes of ends, and ends with the probes of begins, are dealt
by ranges of (sequence, position), rows of one position too, and staged with
the number of their block.  Running sums within blocks and the totals of
earlier blocks (a row for each block and sequence) make up the running sums,
so a sequence that holds most rows is spread over as many tasks as its rows
need, and work follows the rows of both sides and not their overlaps.

A range that ends before it begins overlaps the features that hold both its
points.  Such ranges, where there are any, are joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import discard, staged
from .intervals import TOP
from .overlap_join import range_join

#: The running sums over begins and over ends.
_BEGINS, _ENDS = 0, 1
#: At one position: a probe of what stands before it, the features there, a probe of what stands up to it.
_BEFORE, _THERE, _UPTO = 0, 1, 2


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _probe(track: int, pos: Column, kind: int) -> Column:
    return F.struct(F.lit(track).alias("track"), pos.cast("long").alias("pos"), F.lit(kind).alias("kind"))


def _sums(queries: DataFrame, key: Column, rid: Column, probes: Sequence[Column], features: DataFrame, feature: Sequence[Column | str], begins: Mapping[str, Column], ends: Mapping[str, Column], ceiling: int) -> DataFrame:
    """Rows (key, track, kind, m_<name> ...), staged: what each probe reads of the sums over begins or ends on its sequence."""
    f_rid, f_beg, f_end = map(_column, feature)
    asked = queries.select(key.alias("key"), rid.alias("rid"), F.explode(F.array(*probes)).alias("e")).select("key", "rid", "e.*").filter("rid is not null and pos is not null")
    sound = F.col("rid").isNotNull() & (F.col("end") - F.col("beg")).between(0, 16**ceiling)
    held = features.select(f_rid.cast(asked.schema["rid"].dataType).alias("rid"), f_beg.cast("long").alias("beg"), f_end.cast("long").alias("end"), *[c.alias(f"b_{n}") for n, c in begins.items()], *[c.alias(f"e_{n}") for n, c in ends.items()]).filter(sound)
    sides = ((_BEGINS, "beg", "b"), (_ENDS, "end", "e"))
    steps = [F.struct(F.lit(track).alias("track"), F.col(pos).alias("pos"), F.lit(_THERE).alias("kind"), *[F.col(f"{side}_{n}").alias(f"m_{n}") for n in begins]) for track, pos, side in sides]
    given = held.select("rid", F.explode(F.array(*steps)).alias("e")).select("rid", "e.*")
    events = asked.unionByName(given, allowMissingColumns=True)
    dealt = events.repartitionByRange("track", "rid", "pos", "kind", F.monotonically_increasing_id()).withColumn("block", F.spark_partition_id())
    blocks = staged(dealt, "overlap-sums")
    by, names = ["track", "rid", "block"], [f"m_{n}" for n in begins]
    # What each block adds to its sequences; a block without features there still needs what stands before it.
    sizes = blocks.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    earlier = Window.partitionBy("track", "rid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in names])
    within = Window.partitionBy(*by).orderBy("pos", "kind")
    running = blocks.select(*by, "key", "kind", *[F.coalesce(F.sum(n).over(within), F.lit(0)).alias(n) for n in names]).filter(F.col("kind") != _THERE)
    read = staged(running.join(before, by).select("key", "track", "kind", *[(F.col(n) + F.col(f"before_{n}")).alias(n) for n in names]), "overlap-reads")
    discard(blocks)
    return read


def overlap_sums(
    queries: DataFrame,
    features: DataFrame,
    key: Sequence[str],
    measures: Mapping[str, Column | str] | None = None,
    query: Sequence[Column | str] = ("rid", "beg", "end"),
    feature: Sequence[Column | str] = ("rid", "beg", "end"),
    count: str = "n_overlaps",
    ceiling: int = TOP,
) -> DataFrame:
    """Rows (key, count, measures): of each range, how many features it overlaps and their measures' sums, 0 included.

    `measures` are numeric expressions over `features`; nulls in them count as 0.
    Ranges with a null overlap nothing; features beyond `ceiling` or of
    negative length are left out.  Rows of `queries` that share the key are
    summed together.
    """
    given = {count: F.lit(1).cast("long")} | {n: F.coalesce(_column(m), F.lit(0)) for n, m in (measures or {}).items()}
    rows = queries.select(F.struct(*key).alias("key"), *[F.lit(0).alias(n) for n in given])
    rows = rows.unionByName(_parts(queries, features, key, query, feature, given, ceiling))
    return rows.groupBy("key").agg(*[F.sum(n).alias(n) for n in given]).select("key.*", *given)


def _parts(queries: DataFrame, features: DataFrame, key: Sequence[str], query: Sequence, feature: Sequence, given: Mapping[str, Column], ceiling: int) -> DataFrame:
    """Rows (key, given): several for each range, which add up to the sums over what it overlaps."""
    rid, beg, end = map(_column, query)
    forward = queries.filter(beg.cast("long") <= end.cast("long"))
    probes = [_probe(_BEGINS, end, _UPTO), _probe(_ENDS, beg, _BEFORE)]
    read = _sums(forward, F.struct(*key), rid, probes, features, feature, given, given, ceiling)
    rows = read.select("key", *[F.when(F.col("track") == _BEGINS, F.col(f"m_{n}")).otherwise(-F.col(f"m_{n}")).alias(n) for n in given])
    if _any_reversed(queries, query):
        rows = rows.unionByName(_reversed(queries, features, key, query, feature, given, ceiling))
    return rows


def _any_reversed(queries: DataFrame, query: Sequence[Column | str]) -> bool:
    return not queries.filter(_column(query[2]).cast("long") < _column(query[1]).cast("long")).isEmpty()


def _reversed(queries: DataFrame, features: DataFrame, key: Sequence[str], query: Sequence, feature: Sequence, given: Mapping[str, Column], ceiling: int) -> DataFrame:
    """Ranges that end before they begin, pair by pair."""
    f_rid, f_beg, f_end = map(_column, feature)
    bounds = features.select(f_rid.alias("_r"), f_beg.alias("_b"), f_end.alias("_e"), *[c.alias(n) for n, c in given.items()])
    rid, beg, end = map(_column, query)
    odd = queries.filter(end.cast("long") < beg.cast("long")).select(F.struct(*key).alias("key"), rid.alias("_rid"), beg.alias("_beg"), end.alias("_end"))
    return range_join(odd, bounds, ("_rid", "_beg", "_end"), ("_r", "_b", "_e"), ceiling=ceiling, suffix="").select("key", *given)


def overlap_counts(queries: DataFrame, features: DataFrame, key: Sequence[str], count: str = "n_overlaps", **args) -> DataFrame:
    """Rows (key, count): how many features each range overlaps, 0 included."""
    return overlap_sums(queries, features, key, count=count, **args)


def other_counts(rows: DataFrame, key: str, range_: Sequence[Column | str] = ("rid", "beg", "end"), count: str = "n_overlaps", ceiling: int = TOP) -> DataFrame:
    """Rows (key, count): of each key, how many overlaps its rows have with rows of other keys, 0 included.

    This counts a table's left join with itself whose residual is that the
    keys differ; a null key differs from none.  A row overlaps itself, and
    where keys are repeated the overlaps among a key's rows are running sums
    too, on a sequence of their own.
    """
    rid, beg, end = map(_column, range_)
    named, given = rows.filter(F.col(key).isNotNull()), {count: F.lit(1).cast("long")}
    itself = F.coalesce((rid.isNotNull() & (end.cast("long") - beg.cast("long")).between(0, 16**ceiling)).cast("long"), F.lit(0))
    of_key = F.struct(key).alias("key")
    parts = rows.select(of_key, F.when(F.col(key).isNull(), 0).otherwise(-itself).alias(count)).unionByName(_parts(named, named, [key], range_, range_, given, ceiling))
    repeated = staged(named.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), "repeated-keys")
    if repeated.isEmpty():
        discard(repeated)
    else:
        alike = named.join(repeated, key, "left_semi")
        own = (F.when(rid.isNotNull(), F.struct(rid.alias("rid"), F.col(key).alias("of"))), *range_[1:])
        within = _parts(alike, alike, [key], own, own, given, ceiling)
        parts = parts.unionByName(within.select("key", (-F.col(count)).alias(count))).unionByName(alike.select(of_key, itself.alias(count)))
    return parts.groupBy("key").agg(F.sum(count).alias(count)).select("key.*", count)


def overlap_histogram(queries: DataFrame, features: DataFrame, key: Sequence[str], **args) -> DataFrame:
    """Rows (n_overlaps, n_queries)."""
    return overlap_counts(queries, features, key, **args).groupBy("n_overlaps").agg(F.count(F.lit(1)).alias("n_queries"))


def shared_lengths(queries: DataFrame, features: DataFrame, key: Sequence[str], query: Sequence[Column | str] = ("rid", "beg", "end"), feature: Sequence[Column | str] = ("rid", "beg", "end"), ceiling: int = TOP) -> DataFrame:
    """Rows (key, n_overlaps, shared): of each range, how many features it overlaps and the lengths shared with them in all.

    The shared length with one feature is the lesser end less the larger
    begin.  Of the features that end within the range the lesser end is their
    own, of the others the range's; likewise with begins.  So it takes running
    counts and running sums of positions, each read at both points.  A range
    with a null, or that ends before it begins, shares nothing.
    """
    rid, beg, end = map(_column, query)
    forward = queries.filter(beg.cast("long") <= end.cast("long"))
    probes = [_probe(track, pos, kind) for track in (_BEGINS, _ENDS) for pos, kind in ((end, _UPTO), (beg, _BEFORE))]
    begins, ends = ({"n": F.lit(1).cast("long"), "pos": F.col(c)} for c in ("beg", "end"))
    bounds = features.select(*[_column(x).alias(c) for c, x in zip(("rid", "beg", "end"), feature, strict=True)])
    bounds = bounds.select("rid", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end"))
    name = F.struct(F.struct(*key).alias("key"), beg.cast("long").alias("beg"), end.cast("long").alias("end"))
    read = _sums(forward, name, rid, probes, bounds, ("rid", "beg", "end"), begins, ends, ceiling)
    at_end, of_begins = F.col("kind") == _UPTO, F.col("track") == _BEGINS
    n = F.when(at_end & of_begins, F.col("m_n")).when(~at_end & ~of_begins, -F.col("m_n")).otherwise(0)
    beyond = F.when(at_end, F.col("key.end")).otherwise(F.col("key.beg")) * F.col("m_n") - F.col("m_pos")
    signed = F.when(at_end == of_begins, beyond).otherwise(-beyond)
    rows = queries.select(F.struct(*key).alias("key"), F.lit(0).alias("n_overlaps"), F.lit(0).alias("shared")).unionByName(read.select("key.key", n.alias("n_overlaps"), signed.alias("shared")))
    return rows.groupBy("key").agg(F.sum("n_overlaps").alias("n_overlaps"), F.sum("shared").alias("shared")).select("key.*", "n_overlaps", "shared")

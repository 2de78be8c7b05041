"""Queries over the driver tables, each with the SQL that gives the same rows.

Features are derived from the star schema: short ones (1 to 50 days) and
medium ones (up to 2000 days) from lineitem, long ones from orders, points
from events, and a few windows from nation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_docs, natural_order, nucleotides, range_text
from ..operators import intervals as iv
from ..operators import overlap_join as oj
from ..operators import overlap_sums as os_
from ..operators import refseq
from ..operators.circular import circular_join
from ..sources.bed import read_bed
from ..sources.sam import read_sam
from ..sources.tables import read_tables, write_tables
from ..sources.vcf import read_vcf, read_vcf_lines
from . import layout, session
from .staging import shared_dir
from .tiles import tiled_join, write_tiled

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The derived features in SQL that both engines read ({day} is the day number of a timestamp).
_FEATURES = {
    "short": "SELECT l_returnflag AS rid, {day} AS beg, {day} + CAST(l_quantity AS BIGINT) AS stop, l_orderkey, l_linenumber, l_suppkey FROM lineitem",
    "medium": "SELECT l_linestatus AS rid, {day} AS beg, {day} + l_partkey AS stop, l_orderkey, l_linenumber FROM lineitem",
    "long": "SELECT CAST(o_custkey % 24 AS BIGINT) AS rid, o_orderkey * 100 AS beg, o_orderkey * 100 + CAST(floor(o_totalprice) AS BIGINT) AS stop, o_orderkey FROM orders",
    "sparse": "SELECT CAST(o_custkey % 24 AS BIGINT) AS rid, o_orderkey * 100 AS beg, o_orderkey * 100 + o_custkey AS stop, o_orderkey FROM orders",
    "points": "SELECT CAST(user_id % 24 AS BIGINT) AS rid, event_id * 150 AS beg, event_id * 150 AS stop, event_id FROM events",
    "windows": "SELECT CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS rid, CAST(9200 + n_nationkey * 97 AS BIGINT) AS beg, CAST(9200 + n_nationkey * 97 + n_nationkey * 2 AS BIGINT) AS stop, CAST(n_nationkey AS BIGINT) AS window_id FROM nation",
}
_DAY = {"spark": "CAST(datediff(l_shipdate, DATE'1970-01-01') AS BIGINT)", "duck": "CAST(l_shipdate::DATE - DATE '1970-01-01' AS BIGINT)"}


def _level_sql(length: str, floor: int = 0) -> str:
    return f"CASE WHEN {length} < 0 THEN NULL " + " ".join(f"WHEN {length} <= {16**k} THEN {k}" for k in range(floor, 16)) + " END"


def _with(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_FEATURES[n].format(day=_DAY['duck'])})" for n in names) + " " + body


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _features(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived feature table, projected from its source (no view is left behind)."""
    text = _FEATURES[name].format(day=_DAY["spark"])
    columns, source = text.removeprefix("SELECT ").split(" FROM ")
    return _table(spark, sf_dir, source).selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


def _view(df: DataFrame, name: str) -> str:
    """A temporary view under a name of its own, so that queries that run at once don't meet."""
    own = f"{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(own)
    return own


def _indexed(spark: SparkSession, sf_dir: str, name: str, floor: int | None = None) -> DataFrame:
    return iv.with_range_columns(_features(spark, sf_dir, name), "rid", "beg", "stop", floor)


def _query(sql: str | None, *features: str, also: str | None = None):
    """Registers a query with its SQL; `also` is a second name, under which it ran over whole inputs before its own did."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        for name in filter(None, (f.__name__, also)):
            _QUERIES[name] = f
            if sql:
                _SQL[name] = _with(sql, *features) if features else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join_pairs_agg(spark, sf_dir)




def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


_RANGE_ARGS = {"query": ("rid", "beg", "stop"), "feature": ("rid", "beg", "stop")}

# --- range columns and levels ----------------------------------------------------------------------------------------


@_query(f"SELECT -({_level_sql('stop - beg')}) AS lvl, count(*) AS n, CAST(sum(stop - beg) AS BIGINT) AS total FROM medium GROUP BY 1", "medium")
def gri_levels_hist(spark, sf_dir):
    df = _indexed(spark, sf_dir, "medium")
    return df.groupBy(F.col(iv.LVL).alias("lvl")).agg(_count(), F.sum(iv.LEN).alias("total"))


@_query(f"SELECT -({_level_sql('stop - beg', 2)}) AS lvl, count(*) AS n FROM medium GROUP BY 1", "medium")
def gri_levels_floor2(spark, sf_dir):
    return _indexed(spark, sf_dir, "medium", 2).groupBy(F.col(iv.LVL).alias("lvl")).agg(_count())


@_query(f"SELECT max({_level_sql('stop - beg')}) AS _gri_ceiling, min({_level_sql('stop - beg')}) AS _gri_floor FROM long WHERE rid IS NOT NULL", "long")
def gri_index_levels(spark, sf_dir):
    return iv.occupied_levels(_indexed(spark, sf_dir, "long"))


@_query(f"SELECT coalesce(max({_level_sql('stop - beg')}), 15) AS _gri_ceiling, coalesce(min({_level_sql('stop - beg')}), 0) AS _gri_floor FROM long WHERE beg < 0", "long")
def gri_index_levels_empty(spark, sf_dir):
    return iv.occupied_levels(_indexed(spark, sf_dir, "long").filter("beg < 0"))


@_query(f"SELECT rid, -({_level_sql('stop - beg', 1)}) AS lvl, count(*) AS n, CAST(sum(beg) AS BIGINT) AS begins FROM long GROUP BY 1, 2", "long")
def gri_columns_sql(spark, sf_dir):
    """Range columns by SQL text."""
    plain = _view(_features(spark, sf_dir, "long"), "long_plain")
    df = spark.sql(iv.range_columns_sql(plain, "rid", "beg", "stop", 1))
    return df.groupBy(F.col(iv.RID).alias("rid"), F.col(iv.LVL).alias("lvl")).agg(_count(), F.sum(iv.BEG).alias("begins"))


# --- lookups ---------------------------------------------------------------------------------------------------------


@_query("SELECT l_orderkey, l_linenumber, beg, stop FROM short WHERE rid = 'A' AND beg <= 9510 AND stop >= 9500", "short")
def gri_lookup_const(spark, sf_dir):
    return iv.lookup(_indexed(spark, sf_dir, "short"), "A", 9500, 9510, 15, 0).select("l_orderkey", "l_linenumber", "beg", "stop")


@_query("SELECT count(*) AS n, count(CASE WHEN stop = e THEN 1 END) AS touching FROM short, (SELECT max(stop) AS e FROM short WHERE rid = 'R' AND beg < 9500) WHERE rid = 'R' AND beg <= e + 3 AND stop >= e", "short")
def gri_lookup_abutting(spark, sf_dir):
    df = _indexed(spark, sf_dir, "short")
    last = df.filter("rid = 'R' and beg < 9500").agg(F.max("stop").alias("e"))
    joined = df.crossJoin(F.broadcast(last))  # one row
    return joined.filter(iv.overlaps(F.lit("R"), F.col("e"), F.col("e") + 3)).agg(_count(), F.count(F.when(F.col("stop") == F.col("e"), 1)).alias("touching"))


@_query("SELECT rid, count(*) AS n FROM medium WHERE rid = 'O' AND beg <= 10000 AND stop >= 9900 AND stop - beg <= 16 GROUP BY rid", "medium")
def gri_lookup_bounded(spark, sf_dir):
    return iv.lookup(_indexed(spark, sf_dir, "medium"), "O", 9900, 10000, 1, 0).groupBy("rid").agg(_count())


@_query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM medium WHERE rid = 'F' AND beg <= 9500 AND stop >= 9490", "medium")
def gri_lookup_sql(spark, sf_dir):
    df = _indexed(spark, sf_dir, "medium")
    view = _view(df.withColumn("_rowid_", F.xxhash64("l_orderkey", "l_linenumber", "beg", "stop")), "medium_features")
    ids = iv.rowids_sql(view, spark=spark)
    return spark.sql(f"SELECT count(*) AS n, sum(l_orderkey) AS keys FROM {view} WHERE _rowid_ IN {ids}", args={"qrid": "F", "qbeg": 9490, "qend": 9500})


@_query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM long WHERE rid = 5 AND beg <= 600000 AND stop >= 500000", "long")
def gri_lookup_tvf(spark, sf_dir):
    view = _view(_indexed(spark, sf_dir, "long").withColumn("_rowid_", F.col("o_orderkey")), "long_features")
    iv.register_lookup(spark, f"{view}_rowids", view, "BIGINT")
    return spark.sql(f"SELECT count(*) AS n, sum(_rowid_) AS keys FROM {view}_rowids(5, 500000, 600000)")


@_query("SELECT o_orderkey AS _rowid_ FROM long WHERE rid = 7 AND beg <= 900000 AND stop >= 800000", "long")
def gri_rowids(spark, sf_dir):
    return iv.rowids(_indexed(spark, sf_dir, "long"), 7, 800000, 900000, rowid="o_orderkey").withColumnRenamed("o_orderkey", "_rowid_")


@_query("SELECT count(*) AS n FROM short WHERE rid = 'N' AND beg <= 9700 AND stop >= 9650 AND beg >= 9650 AND stop <= 9700", "short")
def gri_contained(spark, sf_dir):
    return iv.lookup(_indexed(spark, sf_dir, "short"), "N", 9650, 9700, 15, 0).filter(iv.contained(9650, 9700)).agg(_count())


@_query("SELECT count(*) AS n FROM short WHERE rid = 'N' AND beg < 9700 AND stop > 9650", "short")
def gri_strict(spark, sf_dir):
    return iv.lookup(_indexed(spark, sf_dir, "short"), "N", 9650, 9700, 15, 0).filter(iv.strictly_overlaps(9650, 9700)).agg(_count())


@_query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM long WHERE nullif(rid, 0) IS NULL", "long")
def gri_null_rid(spark, sf_dir):
    df = iv.with_range_columns(_features(spark, sf_dir, "long"), "nullif(rid, 0)", "beg", "stop")
    return df.filter(F.col(iv.RID).isNull()).agg(_count(), F.sum("o_orderkey").alias("keys"))


@_query("SELECT rid, beg, stop - beg AS len, l_orderkey, l_linenumber FROM short ORDER BY rid, beg, len, l_orderkey, l_linenumber, l_suppkey LIMIT 100", "short")
def gri_genomic_order_topk(spark, sf_dir):
    df = _indexed(spark, sf_dir, "short").orderBy(iv.RID, iv.BEG, iv.LEN, "l_orderkey", "l_linenumber", "l_suppkey").limit(100)
    return df.select("rid", "beg", F.col(iv.LEN).alias("len"), "l_orderkey", "l_linenumber")


@_query("SELECT o_orderkey FROM long WHERE rid = 3 AND (beg <= 20000 AND stop >= 1000 OR beg <= 1520000 AND stop >= 1501000)", "long")
def gri_circular(spark, sf_dir):
    return iv.circular_lookup(_indexed(spark, sf_dir, "long"), 3, 1000, 20000, 1_500_000).select("o_orderkey")


@_query("SELECT count(*) AS n FROM long, (SELECT min(o_orderkey) AS k FROM long WHERE rid = 4 AND beg <= 400000 AND stop >= 300000) WHERE o_orderkey >= k", "long")
def gri_first_rowid_scan(spark, sf_dir):
    df = _indexed(spark, sf_dir, "long").withColumn("_rowid_", F.col("o_orderkey"))
    return iv.scan_from_first(df, 4, 300000, 400000).agg(_count())


# --- overlap joins ---------------------------------------------------------------------------------------------------


@_query("SELECT p.rid, count(*) AS n, CAST(sum(l.o_orderkey) AS BIGINT) AS keys FROM points p JOIN long l ON p.rid = l.rid AND l.beg <= p.stop AND l.stop >= p.beg GROUP BY p.rid", "points", "long")
def range_join_count(spark, sf_dir):
    """No pair is listed: counts and sums of keys are running sums."""
    sums = os_.overlap_sums(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "long"), ["rid", "event_id"], {"keys": "o_orderkey"}, count="n", **_RANGE_ARGS)
    return sums.filter("n > 0").groupBy("rid").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


@_query("SELECT p.rid, count(*) AS n, CAST(sum(l.o_orderkey) AS BIGINT) AS keys FROM points p JOIN long l ON p.rid = l.rid AND l.beg <= p.stop AND l.stop >= p.beg GROUP BY p.rid", "points", "long")
def range_join_bins(spark, sf_dir):
    """The same by a join on bins, pair by pair."""
    pairs = oj.range_join(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "long"), strategy="bins", **_RANGE_ARGS)
    return pairs.groupBy("rid").agg(_count(), F.sum("o_orderkey").alias("keys"))


@_query("SELECT a.o_orderkey, count(*) AS n_overlaps, CAST(sum(least(a.stop, b.stop) - greatest(a.beg, b.beg)) AS BIGINT) AS shared FROM long a JOIN long b ON a.rid = b.rid AND b.beg <= a.stop AND b.stop >= a.beg GROUP BY 1", "long")
def range_shared_lengths(spark, sf_dir):
    """How much each order shares with all others and itself, without a pair."""
    df = _features(spark, sf_dir, "long")
    return os_.shared_lengths(df, df, ["o_orderkey"], **_RANGE_ARGS)


def _tiled(spark: SparkSession, sf_dir: str, *names: str) -> list[str]:
    """Derived features as tables in the tiles of the last of them; names and places are drawn, so runs don't meet."""
    tag, tiles, tables = uuid.uuid4().hex, None, []
    for name in reversed(names):
        tables.insert(0, f"tiled_{name}_{tag}")
        tiles = write_tiled(_features(spark, sf_dir, name), tables[0], f"{shared_dir(spark)}/{tables[0]}", ("rid", "beg", "stop"), tiles)
    return tables


@_query("SELECT p.rid, count(*) AS n, CAST(sum(l.o_orderkey) AS BIGINT) AS keys FROM points p JOIN long l ON p.rid = l.rid AND l.beg <= p.stop AND l.stop >= p.beg GROUP BY p.rid", "points", "long")
def range_join_tiled(spark, sf_dir):
    """Two tables of the same tiles, joined without a shuffle of either."""
    return tiled_join(spark, *_tiled(spark, sf_dir, "points", "long")).groupBy("rid").agg(_count(), F.sum("o_orderkey").alias("keys"))


@_query("SELECT a.o_orderkey, count(*) AS n FROM long a JOIN long b ON a.rid = b.rid AND b.beg <= a.stop AND b.stop >= a.beg AND a.o_orderkey <> b.o_orderkey GROUP BY 1", "long")
def range_self_join_tiled(spark, sf_dir):
    (table,) = _tiled(spark, sf_dir, "long")
    return tiled_join(spark, table, table, "o_orderkey <> o_orderkey_f").groupBy("o_orderkey").agg(_count())


@_query(
    f"SELECT {_level_sql('a.stop - a.beg')} AS lvl, count(*) AS n, CAST(sum(least(a.stop, b.stop) - greatest(a.beg, b.beg)) AS BIGINT) AS overlap FROM long a JOIN long b ON a.rid = b.rid AND b.beg <= a.stop AND b.stop >= a.beg GROUP BY 1",
    "long",
)
def range_join_pairs_agg(spark, sf_dir):
    df = _features(spark, sf_dir, "long")
    pairs = oj.range_join(df, df, strategy="bins", **_RANGE_ARGS)
    shared = F.least("stop", "stop_f") - F.greatest("beg", "beg_f")
    return pairs.groupBy(iv.level_of(F.col("stop") - F.col("beg")).alias("lvl")).agg(_count(), F.sum(shared).alias("overlap"))


@_query("SELECT w.window_id, count(*) AS n, CAST(sum(s.l_orderkey) AS BIGINT) AS keys FROM short s JOIN windows w ON s.rid = w.rid AND w.beg <= s.stop AND w.stop >= s.beg GROUP BY 1", "short", "windows")
def range_join_broadcast(spark, sf_dir):
    pairs = oj.range_join(_features(spark, sf_dir, "short"), _features(spark, sf_dir, "windows"), strategy="broadcast", **_RANGE_ARGS)
    return pairs.groupBy("window_id").agg(_count(), F.sum("l_orderkey").alias("keys"))


@_query("SELECT p.event_id, s.o_orderkey FROM points p LEFT JOIN sparse s ON p.rid = s.rid AND s.beg <= p.stop AND s.stop >= p.beg", "points", "sparse", also="range_left_join_whole")
def range_left_join(spark, sf_dir):
    pairs = oj.range_join(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "sparse"), how="left", strategy="bins", **_RANGE_ARGS)
    return pairs.select("event_id", "o_orderkey")


@_query("SELECT a.o_orderkey, count(b.o_orderkey) AS n FROM sparse a LEFT JOIN sparse b ON a.rid = b.rid AND b.beg <= a.stop AND b.stop >= a.beg AND a.o_orderkey <> b.o_orderkey GROUP BY 1", "sparse", also="range_self_join_whole")
def range_self_join_residual(spark, sf_dir):
    """The residual only sets keys apart, so no pair is listed: counts are running sums."""
    return os_.other_counts(_features(spark, sf_dir, "sparse"), "o_orderkey", ("rid", "beg", "stop"), count="n")


@_query("SELECT event_id FROM points p WHERE EXISTS (SELECT 1 FROM sparse s WHERE p.rid = s.rid AND s.beg <= p.stop AND s.stop >= p.beg)", "points", "sparse", also="range_semi_whole")
def range_semi(spark, sf_dir):
    return oj.range_join(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "sparse"), how="left_semi", strategy="bins", **_RANGE_ARGS).select("event_id")


@_query("SELECT event_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM sparse s WHERE p.rid = s.rid AND s.beg <= p.stop AND s.stop >= p.beg)", "points", "sparse", also="range_anti_whole")
def range_anti(spark, sf_dir):
    return oj.range_join(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "sparse"), how="left_anti", strategy="bins", **_RANGE_ARGS).select("event_id")


@_query(
    "SELECT n_overlaps, count(*) AS n_queries FROM (SELECT p.event_id, count(s.o_orderkey) AS n_overlaps FROM points p LEFT JOIN long s ON p.rid = s.rid AND s.beg <= p.stop AND s.stop >= p.beg GROUP BY 1) GROUP BY 1",
    "points", "long",
)
def range_hist(spark, sf_dir):
    return os_.overlap_histogram(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "long"), ["event_id"], **_RANGE_ARGS)


@_query("SELECT w.window_id, count(s.o_orderkey) AS n FROM (SELECT window_id, window_id % 24 AS rid, window_id * 5000 AS b FROM windows) w LEFT JOIN long s ON w.rid = s.rid AND s.beg <= w.b + 20000 AND s.stop >= w.b GROUP BY 1", "windows", "long")
def range_lateral_tvf(spark, sf_dir):
    view = _view(_indexed(spark, sf_dir, "long").withColumn("_rowid_", F.col("o_orderkey")), "long_features")
    iv.register_lookup(spark, f"{view}_rowids", view, "BIGINT")
    windows = _view(_features(spark, sf_dir, "windows"), "query_windows")
    return spark.sql(
        f"SELECT w.window_id, count(t._rowid_) AS n FROM (SELECT window_id, window_id % 24 AS rid, window_id * 5000 AS b FROM {windows}) w "
        f"LEFT JOIN LATERAL {view}_rowids(w.rid, w.b, w.b + 20000) AS t GROUP BY w.window_id"
    )


@_query("SELECT p.rid, count(*) AS n, CAST(sum(l.o_orderkey) AS BIGINT) AS keys FROM points p JOIN sparse l ON p.rid = l.rid AND l.beg <= p.stop AND l.stop >= p.beg GROUP BY p.rid", "points", "sparse")
def range_join_auto(spark, sf_dir):
    """The way that the sizes call for, as users get it."""
    pairs = oj.range_join(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "sparse"), **_RANGE_ARGS)
    return pairs.groupBy("rid").agg(_count(), F.sum("o_orderkey").alias("keys"))


@_query("SELECT o_orderkey, beg, stop FROM long WHERE rid = 5 AND beg <= 600000 AND stop >= 500000", "long")
def gri_indexed_layout(spark, sf_dir):
    """A lookup on a table laid out by level and begin, pruned by partition and row group."""
    path = f"{shared_dir(spark)}/indexed-{uuid.uuid4().hex}"
    layout.write_indexed(_indexed(spark, sf_dir, "long"), path)
    return iv.lookup(layout.read_indexed(spark, path), 5, 500_000, 600_000).select("o_orderkey", "beg", "stop")


@_query(f"SELECT max({_level_sql('stop - beg')}) AS ceiling, min({_level_sql('stop - beg')}) AS floor, count(*) FILTER (rid = 'O' AND beg <= 10000 AND stop >= 9900) AS n FROM medium", "medium")
def gri_levels_of_layout(spark, sf_dir):
    """Levels told by the partitions of a table, also of rows appended later, and a lookup by them."""
    path, features = f"{shared_dir(spark)}/indexed-{uuid.uuid4().hex}", _indexed(spark, sf_dir, "medium")
    layout.write_indexed(features.filter(F.col(iv.LVL) > -2), path)
    layout.write_indexed(features.filter(~(F.col(iv.LVL) > -2)), path, mode="append")
    table = layout.read_indexed(spark, path)
    levels = iv.detect_levels(table)
    return iv.lookup(table, "O", 9900, 10000).agg(F.lit(levels.ceiling).alias("ceiling"), F.lit(levels.floor).alias("floor"), _count())


# --- circular sequences, schemas ------------------------------------------------------------------------------------


def _circular_refseqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-four sequences that end where the last order begins; those of even id are circular."""
    length = 100 * _table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return refseq.put_sequences(refseq.empty(spark), [refseq.RefSeq(k, f"s{k}", length, None, None, {"circular": k % 2 == 0}) for k in range(24)])


_TURN = "(SELECT 100 * max(o_orderkey) FROM orders)"
_AROUND = f"p.rid = l.rid AND (l.beg <= p.stop AND l.stop >= p.beg OR p.rid % 2 = 0 AND (l.beg <= p.stop + {_TURN} AND l.stop >= p.beg + {_TURN} OR l.beg <= p.stop - {_TURN} AND l.stop >= p.beg - {_TURN}))"


@_query(f"SELECT p.rid, count(*) AS n, CAST(sum(l.o_orderkey) AS BIGINT) AS keys FROM points p JOIN long l ON {_AROUND} GROUP BY p.rid", "points", "long")
def circular_range_join(spark, sf_dir):
    pairs = circular_join(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "long"), _circular_refseqs(spark, sf_dir), **_RANGE_ARGS)
    return pairs.groupBy("rid").agg(_count(), F.sum("o_orderkey").alias("keys"))


@_query(f"SELECT p.event_id, count(l.o_orderkey) AS n FROM points p LEFT JOIN long l ON {_AROUND} GROUP BY 1", "points", "long")
def circular_range_left_join(spark, sf_dir):
    pairs = circular_join(_features(spark, sf_dir, "points"), _features(spark, sf_dir, "long"), _circular_refseqs(spark, sf_dir), how="left", **_RANGE_ARGS)
    return pairs.groupBy("event_id").agg(F.count("o_orderkey").alias("n"))


@_query("SELECT p.rid, count(*) AS n, CAST(sum(l.o_orderkey) AS BIGINT) AS keys FROM points p JOIN sparse l ON p.rid = l.rid AND l.beg <= p.stop AND l.stop >= p.beg GROUP BY p.rid", "points", "sparse")
def range_join_schemas(spark, sf_dir):
    """Ranges of a table in one attached schema against the indexed table of another."""
    tag = uuid.uuid4().hex
    one, two = f"q{tag}", f"f{tag}"
    _features(spark, sf_dir, "points").write.parquet(f"{shared_dir(spark)}/{one}/points.parquet")
    _features(spark, sf_dir, "sparse").write.parquet(f"{shared_dir(spark)}/{two}/orders.parquet")
    engine = session.Attached(spark)
    (points,), (orders,) = (engine.attach_schema(f"{shared_dir(spark)}/{x}", x) for x in (one, two))
    view = engine.index_table(orders, "rid", "beg", "stop")
    pairs = oj.range_join(spark.table(points), spark.table(view), strategy="bins", query=("rid", "beg", "stop"), feature=(iv.RID, iv.BEG, f"{iv.BEG} + {iv.LEN}"))
    return pairs.groupBy("rid").agg(_count(), F.sum("o_orderkey").alias("keys"))


# --- text sources ----------------------------------------------------------------------------------------------------


def _text(spark: SparkSession, header: list[str], lines: DataFrame) -> str:
    """A folder of text files, the header at the head of the first."""
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    first = spark.createDataFrame([(line,) for line in header], "value string").coalesce(1)
    (first.union(lines) if header else lines).write.text(path)
    return path


_VCF_HEADER = [
    "##fileformat=VCFv4.2", *[f"##contig=<ID=c{i},length=100000000>" for i in range(24)], '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">', '##INFO=<ID=AF,Number=A,Type=Float,Description="share">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="known">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depths">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
]


def _vcf(spark: SparkSession, sf_dir: str) -> str:
    k = "CAST(o_orderkey AS STRING)"
    fields = (
        "concat('c', o_custkey % 24)", "CAST(o_orderkey * 100 + 1 AS STRING)", f"concat('rs', {k}, if(o_custkey % 2 = 0, concat(';x', {k}), ''))", "repeat('A', CAST(1 + o_custkey % 5 AS INT))", "if(o_custkey % 3 = 0, '.', 'C,GG')",
        "if(o_custkey % 4 = 0, '.', CAST(o_custkey AS STRING))", "if(o_custkey % 3 = 0, '.', 'PASS')", "concat('DP=', o_custkey, if(o_custkey % 2 = 0, ';AF=0.5,.;DB', ''), if(o_custkey % 5 = 0, concat(';END=', o_orderkey * 100 + 50), ''))",
        "'GT:AD'", "concat(o_custkey % 2, '/', o_custkey % 3, ':', o_custkey, ',.')", "if(o_custkey % 2 = 0, './.:.', '1|0')",
    )
    return _text(spark, _VCF_HEADER, _table(spark, sf_dir, "orders").select(F.expr(f"concat_ws('\t', {', '.join(fields)})").alias("value")))


@_query("""SELECT CAST(o_custkey % 24 AS BIGINT) AS rid, o_orderkey * 100 AS pos, CASE WHEN o_custkey % 5 = 0 THEN 50 ELSE 1 + o_custkey % 5 END AS rlen, '["rs' || o_orderkey || '"' || CASE WHEN o_custkey % 2 = 0 THEN ',"x' || o_orderkey || '"' ELSE '' END || ']' AS ids,
  CASE WHEN o_custkey % 3 = 0 THEN '[]' ELSE '["C","GG"]' END AS alt, CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey AS BIGINT) END AS qual, CASE WHEN o_custkey % 3 <> 0 THEN '["PASS"]' END AS filter, CAST(o_custkey AS BIGINT) AS dp, CASE WHEN o_custkey % 2 = 0 THEN '[0.5,null]' END AS af, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS db,
  row_number() OVER (ORDER BY o_custkey % 24, o_orderkey) AS variant_rowid FROM orders""")
def vcf_variants(spark, sf_dir):
    variants = read_vcf(spark, _vcf(spark, sf_dir)).variants
    return variants.select("rid", F.col("POS").alias("pos"), F.col("rlen").cast("long"), F.col("ID_jsarray").alias("ids"), F.col("ALT_jsarray").alias("alt"), F.col("QUAL").cast("long").alias("qual"), F.col("FILTER_jsarray").alias("filter"), F.col("DP").alias("dp"), F.col("AF_jsarray").alias("af"), F.coalesce("DB", F.lit(0)).alias("db"), "variant_rowid")


@_query("""SELECT CAST(o_custkey % 24 AS BIGINT) AS rid, o_orderkey * 100 AS pos, s.sample_name, CASE WHEN s.sample_name = 's1' THEN o_custkey % 2 WHEN o_custkey % 2 = 1 THEN 1 END::BIGINT AS gt1, CASE WHEN s.sample_name = 's1' THEN o_custkey % 3 WHEN o_custkey % 2 = 1 THEN 0 END::BIGINT AS gt2,
  CASE WHEN s.sample_name = 's1' THEN 2 WHEN o_custkey % 2 = 1 THEN -2 ELSE 0 END::BIGINT AS ploidy, CASE WHEN s.sample_name = 's1' THEN '[' || o_custkey || ',null]' END AS depths FROM orders, (SELECT unnest(['s1', 's2']) AS sample_name) s""")
def vcf_genotypes(spark, sf_dir):
    vcf = read_vcf(spark, _vcf(spark, sf_dir))
    calls = vcf.genotypes.join(vcf.variants.select("variant_rowid", "rid", F.col("POS").alias("pos")), "variant_rowid").join(F.broadcast(vcf.samples), "sample_id")  # two samples
    return calls.select("rid", "pos", "sample_name", F.col("GT1").alias("gt1"), F.col("GT2").alias("gt2"), F.col("GT_ploidy").alias("ploidy"), F.col("AD_jsarray").alias("depths"))


@_query("SELECT 'c' || o_custkey % 24 AS chrom, o_orderkey * 100 AS pos, CAST(CASE WHEN o_custkey % 5 = 0 THEN 50 ELSE 1 + o_custkey % 5 END AS BIGINT) AS rlen FROM orders UNION ALL SELECT NULL, NULL, NULL")
def vcf_lines(spark, sf_dir):
    rows = read_vcf_lines(spark, _vcf(spark, sf_dir))
    return rows.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("rlen").cast("long"))


_SAM_HEADER = [*[f"@SQ\tSN:c{i}\tLN:100000000" for i in range(24)], "@RG\tID:g0\tSM:a", "@RG\tID:g1\tSM:b"]


def _sam(spark: SparkSession, sf_dir: str):
    fields = ("concat('r', o_orderkey)", "CAST(o_custkey % 3 AS STRING)", "concat('c', o_custkey % 24)", "CAST(o_orderkey * 10 + 1 AS STRING)", "'60'", "concat('5M', 2 * 1, 'I', o_custkey % 7 + 0, 'D3M')", "if(o_custkey % 2 = 0, '=', '*')", "'0'", "'0'", "'ACGT'", "'*'", "concat('NM:i:', o_custkey)", "concat('RG:Z:g', o_custkey % 2)", "'XT:Z:a:b'")
    lines = _table(spark, sf_dir, "orders").select(F.expr(f"concat_ws('\t', {', '.join(fields)})").alias("value"))
    return read_sam(spark, _text(spark, _SAM_HEADER, lines))


@_query("""SELECT 'r' || o_orderkey AS qname, CAST(o_custkey % 3 AS BIGINT) AS flag, CAST(o_custkey % 24 AS BIGINT) AS rid, o_orderkey * 10 AS pos, o_orderkey * 10 + 5 + o_custkey % 7 + 3 AS endpos, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 24 AS BIGINT) END AS rnext,
  CAST(o_custkey % 2 AS BIGINT) AS rg_id, 'ACGT' AS seq, '{"NM":' || o_custkey || ',"XT":"a:b"}' AS tags FROM orders""")
def sam_reads(spark, sf_dir):
    sam = _sam(spark, sf_dir)
    rows = sam.reads.join(sam.seqs, "rowid").join(sam.tags, "rowid")
    return rows.select("qname", "flag", "rid", "pos", "endpos", "rnext", "rg_id", "seq", F.col("tags_json").alias("tags"))


@_query("SELECT 'r' || o_orderkey AS qname, CAST(o_custkey % 24 AS BIGINT) AS rid, o_orderkey * 10 AS pos FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) // 3 FROM orders)")
def sam_read_by_name(spark, sf_dir):
    """A read looked up by its name in tables laid out by place, through Bloom filters."""
    folder = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
    write_tables(_sam(spark, sf_dir), folder, named={"seqs": ["qname"]})
    tables = read_tables(spark, folder, ["reads", "seqs"])
    name = f"r{_table(spark, sf_dir, 'orders').agg(F.max('o_orderkey')).first()[0] // 3}"
    return tables["seqs"].filter(F.col("qname") == name).join(tables["reads"], "rowid").select("qname", "rid", "pos")


@_query("SELECT 'c' || o_custkey % 24 AS chrom, count(*) AS n, CAST(sum(o_orderkey * 10) AS BIGINT) AS begins FROM orders GROUP BY 1")
def bed_features(spark, sf_dir):
    lines = _table(spark, sf_dir, "orders").select(F.expr("concat_ws('\t', concat('c', o_custkey % 24), o_orderkey * 10 + 1, o_orderkey * 10 + 9, 'x', '0', '+')").alias("value"))
    rows = read_bed(spark, _text(spark, [], lines), one_based=True)
    return rows.groupBy("chrom").agg(_count(), F.sum("beg").alias("begins"))


@_query("""SELECT event_id, CAST(event_id % 3 AS VARCHAR) AS last, CASE event_id % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'text' WHEN 2 THEN 'null' ELSE 'true' END AS kind,
  '[' || json_extract_string(props, '$.k') || ',' || event_id % 3 || ']' AS pair, CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN 't' WHEN 3 THEN '1' END AS shown FROM events""")
def json_paths_mixed(spark, sf_dir):
    """Paths from the end, several paths and mixed types over documents made of every event."""
    last = "CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '\"t\"' WHEN 2 THEN 'null' ELSE 'true' END"
    doc = F.expr(f"concat('{{\"p\":', props, ',\"a\":[[9,', event_id % 3, '],', {last}, ']}}')")
    events = _table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return events.select("event_id", json_docs.json_extract("doc", "$.a[#-2][#-1]").alias("last"), json_docs.json_type("doc", "$.a[#-1]").alias("kind"), json_docs.json_extract("doc", "$.p.k", "$.a[0][#-1]").alias("pair"), json_docs.json_extract("doc", "$.a[#-1]").alias("shown"))


# --- reference sequences ---------------------------------------------------------------------------------------------


@_query("SELECT k AS _gri_rid, 'cust' || k AS gri_refseq_name, CAST(max(o_totalprice) AS BIGINT) + 1000 AS gri_refseq_length FROM (SELECT 1 + o_custkey % 24 AS k, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY k UNION ALL SELECT 25, 'extra', 1000")
def refseq_put_get(spark, sf_dir):
    """Sequences put by name and length, ids as they come, and got by id."""
    lengths = _table(spark, sf_dir, "orders").groupBy((1 + F.col("o_custkey") % 24).alias("k")).agg((F.max(F.floor("o_totalprice")).cast("long") + 1000).alias("length"))
    given = [refseq.RefSeq(-1, f"cust{r['k']}", r["length"], None, None, {}) for r in lengths.orderBy("k").collect()]  # 24 rows
    table = refseq.put_sequence(refseq.put_sequences(refseq.empty(spark), given), "extra", 1000)
    return table.select(F.col("_gri_rid").cast("long"), "gri_refseq_name", F.col("gri_refseq_length").cast("long"))


@_query("SELECT CASE k WHEN 23 THEN 'chrX' WHEN 24 THEN 'chrY' ELSE 'chr' || k END AS gri_refseq_name, count(*) AS n FROM (SELECT n_nationkey AS k FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE k >= 1 GROUP BY 1", also="refseq_join_name_whole")
def refseq_join_name(spark, sf_dir):
    """Nation key 0 names no sequence."""
    table = refseq.put_assembly(refseq.empty(spark))
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("_gri_rid"))
    return refseq.with_names(rows, table).groupBy("gri_refseq_name").agg(_count())


@_query("SELECT 'chr' || (1 + l_suppkey % 20) AS chrom, min(1 + l_suppkey % 20) AS _gri_rid, count(*) AS n FROM lineitem GROUP BY 1")
def refseq_join_rid(spark, sf_dir):
    table = refseq.put_assembly(refseq.empty(spark))
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 20).cast("string")).alias("chrom"))
    return refseq.with_rids(rows, table, "chrom").groupBy("chrom").agg(F.min("_gri_rid").alias("_gri_rid"), _count())


# --- nucleotides, range text, natural order --------------------------------------------------------------------------

# Every letter of a text gives a nucleotide, all else goes.
_LETTERS, _AS_DNA = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGT" * 13
_DNA_CTE = f"WITH d AS (SELECT doc_id, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{_LETTERS}', '{_AS_DNA}') AS dna FROM documents) "


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", "")
    return _table(spark, sf_dir, "documents").select("doc_id", F.translate(letters, _LETTERS, _AS_DNA).alias("dna"))


@_query(_DNA_CTE + "SELECT doc_id, translate(reverse(dna), 'ACGT', 'TGCA') AS rc FROM d", also="dna_revcomp_whole")
def dna_revcomp(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", nucleotides.dna_revcomp("dna").alias("rc"))


@_query("SELECT o_orderkey, 'c' || o_custkey % 24 AS sequence, CAST(o_orderkey * 1000 - 1 AS BIGINT) AS beg, CAST(o_orderkey * 1000 + o_custkey AS BIGINT) AS stop FROM orders WHERE o_orderkey > 0")
def parse_range_parts(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").filter("o_orderkey > 0")  # positions count from 1
    text = F.concat(F.lit("c"), F.col("o_custkey") % 24, F.lit(":"), F.format_number(F.col("o_orderkey") * 1000, 0), F.lit("-"), F.format_number(F.col("o_orderkey") * 1000 + F.col("o_custkey"), 0))
    parts = orders.select("o_orderkey", range_text.parse_range(text).alias("r"))
    return parts.select("o_orderkey", F.col("r.sequence").alias("sequence"), F.col("r.begin").alias("beg"), F.col("r.end").alias("stop"))


@_query(_DNA_CTE + "SELECT doc_id, CASE length(dna) WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE (length(dna) + 3) // 4 + 1 END::INTEGER AS bytes, length(dna)::INTEGER AS nucleotides FROM d", also="twobit_size_whole")
def twobit_size(spark, sf_dir):
    coded = _dna(spark, sf_dir).select("doc_id", nucleotides.nucleotides_twobit("dna").alias("x"))
    return coded.select("doc_id", F.octet_length("x.bits").alias("bytes"), nucleotides.twobit_length("x").alias("nucleotides"))


@_query(_DNA_CTE + "SELECT doc_id, dna FROM d", also="twobit_roundtrip_dna_whole")
def twobit_roundtrip_dna(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", nucleotides.twobit_dna(nucleotides.nucleotides_twobit(F.lower("dna"))).alias("dna"))


@_query(_DNA_CTE + "SELECT doc_id, replace(dna, 'T', 'U') AS rna FROM d", also="twobit_roundtrip_rna_whole")
def twobit_roundtrip_rna(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", nucleotides.twobit_rna(nucleotides.nucleotides_twobit("dna")).alias("rna"))


#: Starts and counts anywhere in the text, from both ends.
_ANYWHERE = ("doc_id * 7919 % (2 * length(dna) + 1) - length(dna)", "doc_id * 104729 % (2 * length(dna) + 1) - length(dna)")
_SLICE = f""", p AS (SELECT doc_id, dna, length(dna) AS n, ({_ANYWHERE[0]})::INTEGER AS y, ({_ANYWHERE[1]})::INTEGER AS z FROM d),
o AS (SELECT *, CASE WHEN y > 0 THEN y - 1 WHEN y < 0 THEN greatest(0, y + n) ELSE 0 END AS ofs FROM p),
c AS (SELECT *, CASE WHEN z < 0 THEN ofs - least(ofs, -z) ELSE ofs END AS start,
  CASE WHEN z < 0 THEN least(ofs, -z) ELSE greatest(0, z - CASE WHEN y = 0 THEN 1 WHEN y < 0 AND -y > n THEN -y - n ELSE 0 END) END AS k FROM o)
SELECT doc_id, substr(dna, (start + 1)::INTEGER, k::INTEGER) AS part FROM c"""


@_query(_DNA_CTE.rstrip() + _SLICE, also="twobit_substr_whole")
def twobit_substr(spark, sf_dir):
    y, z = (F.expr(x).cast("int") for x in _ANYWHERE)
    coded = _dna(spark, sf_dir).select("doc_id", y.alias("y"), z.alias("z"), nucleotides.nucleotides_twobit("dna").alias("x"))
    return coded.select("doc_id", nucleotides.twobit_dna("x", F.col("y"), F.col("z")).alias("part"))


@_query("SELECT p_partkey, p_name AS kept, false AS coded FROM part")
def twobit_passthrough(spark, sf_dir):
    coded = _table(spark, sf_dir, "part").select("p_partkey", nucleotides.nucleotides_twobit("p_name").alias("x"))
    return coded.select("p_partkey", nucleotides.twobit_dna("x").alias("kept"), F.col("x.bits").isNotNull().alias("coded"))


@_query("SELECT 'c' || o_custkey % 24 || 'n' || o_orderkey AS name, CAST(row_number() OVER (ORDER BY o_custkey % 24, o_orderkey) AS INTEGER) AS place FROM orders")
def uint_sort_rank(spark, sf_dir):
    names = _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 24, F.lit("n"), "o_orderkey").alias("name"))
    ranked = layout.with_rowids(names.withColumn("key", natural_order.natural_key("name")), "key", name="place")
    return ranked.select("name", F.col("place").cast("int"))


# --- JSON documents --------------------------------------------------------------------------------------------------


@_query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_extract_agg(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_type", json_docs.json_extract("props", "$.k").cast("bigint").alias("k"))
    return events.groupBy("event_type").agg(_count(), F.sum("k").alias("total"))


@_query("SELECT event_id, '[' || event_id || ',' || user_id || ']' AS pair FROM events")
def json_extract_paths(spark, sf_dir):
    doc = F.to_json(F.struct("event_id", F.array("user_id").alias("r")))
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_extract(doc, "$.event_id", "$.r[0]").alias("pair"))


@_query("SELECT event_id, (event_id % 7)::INTEGER AS whole, 0 AS object, -1 AS absent FROM events")
def json_array_length(spark, sf_dir):
    doc = F.to_json(F.struct(F.array_repeat("user_id", (F.col("event_id") % 7).cast("int")).alias("a"), F.struct("event_type").alias("o")))
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_array_length(doc, "$.a").alias("whole"), json_docs.json_array_length(doc, "$.o").alias("object"), F.coalesce(json_docs.json_array_length(doc, "$.x"), F.lit(-1)).alias("absent"))


@_query("SELECT event_id, 'object' AS root, 'integer' AS i, 'text' AS s, 'real' AS r, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS t, 'array' AS a FROM events")
def json_type(spark, sf_dir):
    doc = F.to_json(F.struct(F.col("event_id").alias("i"), F.col("event_type").alias("s"), (F.col("user_id") + 0.5).alias("r"), (F.col("event_id") % 2 == 0).alias("t"), F.array("user_id").alias("a")))
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_type(doc).alias("root"), *[json_docs.json_type(doc, f"$.{k}").alias(k) for k in "isrta"])


@_query("SELECT event_id % 5 AS g, count(*) AS n, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS valid FROM events GROUP BY 1")
def json_valid(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("g", F.col("event_id") % 5)
    text = F.when(F.col("g") == 0, F.concat(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    return events.groupBy("g").agg(_count(), F.sum(json_docs.json_valid(text)).alias("valid"))


@_query("""SELECT event_id, '{"key":' || event_id || ',"name":"' || event_type || '","none":null}' AS doc FROM events""")
def json_object_build(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_object(("key", "event_id"), ("name", "event_type"), ("none", F.lit(None).cast("int"))).alias("doc"))


@_query("""SELECT event_id, '["' || event_type || '",' || user_id || ',null]' AS doc, '"' || event_type || '"' AS quoted FROM events""")
def json_array_build(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_array("event_type", "user_id", F.lit(None).cast("int")).alias("doc"), json_docs.json_quote("event_type").alias("quoted"))


@_query("SELECT user_id, '[' || string_agg(CASE WHEN event_id % 4 = 0 THEN 'null' ELSE event_id::VARCHAR END, ',' ORDER BY event_id) || ']' AS doc FROM events GROUP BY 1")
def json_group_array(spark, sf_dir):
    value = F.when(F.col("event_id") % 4 != 0, F.col("event_id"))
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(json_docs.json_group_array(value, "event_id").alias("doc"))


@_query("""SELECT user_id, '{' || string_agg('"' || event_type || event_id % 3 || '":' || event_id, ',' ORDER BY event_id) || '}' AS doc FROM events GROUP BY 1""")
def json_group_object(spark, sf_dir):
    label = F.concat("event_type", (F.col("event_id") % 3).cast("string"))
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(json_docs.json_group_object(label, "event_id", "event_id").alias("doc"))


@_query("SELECT event_id, '[' || array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), ',') || ']' AS doc FROM events")
def json_group_array_window(spark, sf_dir):
    frame = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-1, 0)
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_group_array_over("event_id", frame).alias("doc"))


@_query("""SELECT event_id, '{' || array_to_string(list('"' || event_type || '":' || event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') || '}' AS doc FROM events""")
def json_group_object_window(spark, sf_dir):
    frame = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_group_object_over("event_type", "event_id", frame).alias("doc"))


@_query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'integer' AS type, json_extract_string(props, '$.k') AS atom, '$.k' AS fullkey, '$' AS path FROM events")
def json_each(spark, sf_dir):
    return json_docs.json_each(_table(spark, sf_dir, "events").select("event_id", "props"), "props").drop("props")


@_query(
    """SELECT event_id, id, key, value, type, parent, fullkey FROM (
    SELECT event_id, 0 AS id, NULL AS key, '{"a":[' || event_id || '],"n":"' || event_type || '"}' AS value, 'object' AS type, -1 AS parent, '$' AS fullkey FROM events
    UNION ALL SELECT event_id, 2, 'a', '[' || event_id || ']', 'array', 0, '$.a' FROM events
    UNION ALL SELECT event_id, 3, '0', event_id::VARCHAR, 'integer', 2, '$.a[0]' FROM events
    UNION ALL SELECT event_id, 5, 'n', event_type, 'text', 0, '$.n' FROM events)"""
)
def json_tree(spark, sf_dir):
    docs = _table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.array("event_id").alias("a"), F.col("event_type").alias("n"))).alias("doc"))
    rows = docs.lateralJoin(json_docs.json_tree()(F.col("doc").outer()))
    return rows.select("event_id", "id", "key", "value", "type", F.coalesce("parent", F.lit(-1)).alias("parent"), "fullkey")


@_query("""SELECT event_id, '{"k":0}' AS replaced, '{"k":' || json_extract_string(props, '$.k') || ',"new":["x"]}' AS added, props = props AS same FROM events""")
def json_set(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", json_docs.json_set("props", "$.k", F.lit(0)).alias("replaced"), json_docs.json_set("props", "$.new[0]", F.lit("x")).alias("added"), (json_docs.json_minify("props") == json_docs.json_replace("props", "$.no", F.lit(1))).alias("same"))


@_query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS kept, '{"k":' || json_extract_string(props, '$.k') || ',"id":' || event_id || '}' AS added FROM events""")
def json_insert(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_insert("props", "$.k", F.lit(0)).alias("kept"), json_docs.json_insert("props", "$.id", "event_id").alias("added"))


@_query("""SELECT event_id, '{"k":' || event_id || '}' AS put, '{"k":' || json_extract_string(props, '$.k') || '}' AS kept FROM events""")
def json_replace(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_replace("props", "$.k", "event_id").alias("put"), json_docs.json_replace("props", "$.x", "event_id").alias("kept"))


@_query("""SELECT event_id, '{}' AS gone, '{"k":' || json_extract_string(props, '$.k') || '}' AS kept FROM events""")
def json_remove(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_remove("props", "$.k").alias("gone"), json_docs.json_remove("props", "$.x").alias("kept"))


@_query("""SELECT event_id, '{"type":"' || event_type || '"}' AS patched FROM events""")
def json_patch(spark, sf_dir):
    patch = F.concat(F.lit('{"k":null,"type":"'), "event_type", F.lit('"}'))
    return _table(spark, sf_dir, "events").select("event_id", json_docs.json_patch("props", patch).alias("patched"))


# --- relational surface ----------------------------------------------------------------------------------------------


@_query(
    """SELECT r_name, count(*) AS n, count(DISTINCT c_custkey) AS customers, CAST(max(o_orderkey) AS BIGINT) AS last_order
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
    WHERE c_acctbal > 0 AND NOT (o_orderpriority = '1-URGENT') GROUP BY r_name HAVING count(*) > 1"""
)
def relational_surface(spark, sf_dir):
    region, nation, customer, orders = (_table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    joined = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).join(customer.filter("c_acctbal > 0"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    kept = joined.filter(~(F.col("o_orderpriority") == "1-URGENT"))
    return kept.groupBy("r_name").agg(_count(), F.countDistinct("c_custkey").alias("customers"), F.max("o_orderkey").alias("last_order")).filter("n > 1")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def anti_join_topk(spark, sf_dir):
    returned = _table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = _table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_anti")
    return left.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")

"""Options of an engine over a Spark session, and its SQL surface."""

from __future__ import annotations

import dataclasses
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import json_docs
from ..functions.nucleotides import HEX, PAIRS
from ..operators import intervals


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    """Options with defaults; `merged` takes a dict or JSON text, in which null restores the default."""

    shuffle_partitions: int = -1
    adaptive: bool = True
    skew_join: bool = True
    max_partition_mb: int = 128
    advisory_partition_mb: int = 64
    broadcast_mb: int = 10
    zstd_level: int = 6
    time_zone: str = "UTC"

    def merged(self, changes: dict[str, Any] | str | None) -> EngineConfig:
        changes = json.loads(changes) if isinstance(changes, str) else changes or {}
        types = {f.name: type(f.default) for f in dataclasses.fields(self)}
        for k, v in changes.items():
            if k not in types:
                raise ValueError(f"unknown option {k}")
            if v is not None and type(v) is not types[k]:
                raise TypeError(f"{k} must be {types[k].__name__}, not {type(v).__name__}")
        defaults = EngineConfig()
        return dataclasses.replace(self, **{k: getattr(defaults, k) if v is None else v for k, v in changes.items()})

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    def settings(self) -> dict[str, str]:
        found = {
            "spark.sql.adaptive.enabled": str(self.adaptive).lower(), "spark.sql.adaptive.skewJoin.enabled": str(self.skew_join).lower(),
            "spark.sql.files.maxPartitionBytes": f"{self.max_partition_mb}m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{self.advisory_partition_mb}m",
            "spark.sql.autoBroadcastJoinThreshold": f"{self.broadcast_mb}m", "spark.sql.session.timeZone": self.time_zone, "spark.sql.parquet.compression.codec": "zstd",
            "spark.sql.variant.allowDuplicateKeys": "true",
        }
        return found | ({"spark.sql.shuffle.partitions": str(self.shuffle_partitions)} if self.shuffle_partitions > 0 else {})


class Attached:
    """Folders of tables as databases of a session, whose settings stay as they are."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def attach_schema(self, folder: str, schema: str) -> list[str]:
        """The Parquet tables of a folder as tables of a database of their own; their names, such as ``db2.exons``.

        Tables stay where they are; `detach_schema` forgets them.  What is in
        the folder is asked of Spark's own reader, so any store that it reads will do.
        """
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
        root = re.escape(folder.rstrip("/").rpartition("/")[2])
        names = files.select(F.regexp_extract("path", rf"/{root}/([^/]+)\.parquet(?:/|$)", 1).alias("name")).filter("name <> ''").distinct().collect()
        found = sorted(r["name"] for r in names)
        for name in found:
            place = f"{folder.rstrip('/')}/{name}.parquet"
            self.spark.sql(f"CREATE TABLE {schema}.{name} USING parquet LOCATION '{place}'")
            if any(c.isPartition for c in self.spark.catalog.listColumns(f"{schema}.{name}")):
                self.spark.catalog.recoverPartitions(f"{schema}.{name}")
        return [f"{schema}.{name}" for name in found]

    def detach_schema(self, schema: str) -> None:
        """Forgets a database of `attach_schema`; its files stay."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {schema} CASCADE")

    def index_table(self, table: str, rid: str, beg: str, end: str, floor: int | None = None) -> str:
        """A view `table`_gri of a table of a schema with range columns, in that schema, and table functions over it; the view's name.

        Table functions can't have a schema in their names, so those of
        ``db2.exons`` are ``db2_exons_rowids`` and ``db2_exons_levels``, for the session.
        """
        view = f"{table}_gri"
        self.spark.sql(f"CREATE OR REPLACE VIEW {view} AS {intervals.range_columns_sql(table, rid, beg, end, floor)}")
        indexed = self.spark.table(view)
        if "_rowid_" in indexed.columns:
            intervals.register_lookup(self.spark, f"{table.replace('.', '_')}_rowids", view, dict(indexed.dtypes)[intervals.RID])
        intervals.register_levels(self.spark, f"{table.replace('.', '_')}_levels", view)
        return view


class Engine(Attached):
    """A session with the options set and the functions registered."""

    version = __version__

    def __init__(self, spark: SparkSession, config: EngineConfig | dict | str | None = None):
        self.spark = spark
        self.config = config if isinstance(config, EngineConfig) else EngineConfig().merged(config)
        for k, v in self.config.settings().items():
            spark.conf.set(k, v)
        # Read by the Parquet writer's codec.
        spark._jsc.hadoopConfiguration().set("parquet.compression.codec.zstd.level", str(self.config.zstd_level))
        register_functions(spark)

    def attach(self, folder: str, schema: str) -> list[str]:
        """Temporary views `schema`_`table` of the Parquet tables of a folder; their names."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        found = []
        for status in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
            name = status.getPath().getName()
            if name.endswith(".parquet"):
                view = f"{schema}_{name.removesuffix('.parquet')}"
                self.spark.read.parquet(status.getPath().toString()).createOrReplaceTempView(view)
                found.append(view)
        return sorted(found)

    def index(self, view: str, rid: str, beg: str, end: str, floor: int | None = None) -> DataFrame:
        """Adds range columns to a view, and the table functions `view`_rowids and `view`_levels over it."""
        indexed = intervals.with_range_columns(self.spark.table(view), rid, beg, end, floor)
        indexed.createOrReplaceTempView(view)
        if "_rowid_" in indexed.columns:
            kind = dict(indexed.dtypes)[intervals.RID]
            intervals.register_lookup(self.spark, f"{view}_rowids", view, kind)
        intervals.register_levels(self.spark, f"{view}_levels", view)
        return indexed


_SQL_FUNCTIONS = {
    "dna_revcomp(s STRING) RETURNS STRING": "CASE WHEN s RLIKE '[^ACGTacgt]' THEN CAST(raise_error('non-DNA input to dna_revcomp()') AS STRING) ELSE reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) END",
    "parse_genomic_range_sequence(s STRING) RETURNS STRING": "{part}.sequence",
    "parse_genomic_range_begin(s STRING) RETURNS BIGINT": "{part}.begin",
    "parse_genomic_range_end(s STRING) RETURNS BIGINT": "{part}.end",
    "natural_key(s STRING) RETURNS STRING": "array_join(transform(regexp_extract_all(s, '([0-9]+|[^0-9]+)', 1), x -> CASE WHEN x RLIKE '^[0-9]' THEN concat(lpad(length(regexp_replace(x, '^0+(?=.)', '')), 10, '0'), regexp_replace(x, '^0+(?=.)', '')) ELSE x END), '')",
}
_RANGE = r"""(SELECT CASE WHEN s IS NULL THEN NULL WHEN b BETWEEN 1 AND e AND e <= 9223372036854775799 THEN named_struct('sequence', n, 'begin', CAST(b - 1 AS BIGINT), 'end', CAST(e AS BIGINT))
  ELSE CAST(raise_error(concat('parse_genomic_range(): not a range: ', s)) AS STRUCT<sequence: STRING, begin: BIGINT, end: BIGINT>) END
  FROM (SELECT regexp_extract(s, '{p}', 1) AS n, try_cast(concat('0', replace(regexp_extract(s, '{p}', 2), ',', '')) AS DECIMAL(38, 0)) AS b, try_cast(concat('0', replace(regexp_extract(s, '{p}', 3), ',', '')) AS DECIMAL(38, 0)) AS e))"""


_TWOBIT = "STRUCT<bits: BINARY, txt: STRING>"
_PAIRS = "CAST(conv(hex(substring(x.bits, 1, 1)), 16, 10) AS INT)"
_LENGTH = f"CASE WHEN x.bits IS NULL THEN octet_length(x.txt) WHEN octet_length(x.bits) < 2 THEN octet_length(x.bits) ELSE 4 * (octet_length(x.bits) - 1) - ({_PAIRS} & 3) END"
_CODES = "translate(upper(s), 'TUCAG', '00123')"
_CODED = f"""CASE WHEN s IS NULL THEN NULL WHEN s RLIKE '[^\\\\x01-\\\\x7F]' THEN CAST(raise_error("nucleotides_twobit(): text isn't ASCII") AS {_TWOBIT})
  WHEN s = '' OR s RLIKE '[^ACGTUacgtu]' THEN named_struct('bits', CAST(NULL AS BINARY), 'txt', s)
  ELSE named_struct('bits', unhex(CASE WHEN length(s) = 1 THEN lpad({_CODES}, 2, '0') ELSE concat(lpad(hex(pmod(4 - length(s) % 4, 4)), 2, '0'),
    translate(decode(encode(rpad({_CODES}, CAST(ceil(length(s) / 4) * 4 AS INT), '0'), 'US-ASCII'), 'UTF-16BE'), '{PAIRS}', '{HEX}')) END), 'txt', CAST(NULL AS STRING)) END"""


def _decoding(letters: str) -> str:
    """Text of a two-bit value x, or the part of it that starts at y and has z places."""
    whole = f"""CASE WHEN x.bits IS NULL THEN x.txt WHEN octet_length(x.bits) < 2 THEN translate(conv(hex(x.bits), 16, 10), '0123', '{letters}')
      ELSE substr(translate(decode(encode(translate(substr(hex(x.bits), 3), '{HEX}', '{PAIRS}'), 'UTF-16BE'), 'US-ASCII'), '0123', '{letters}'), 1, {_LENGTH}) END"""
    places = "SELECT t, n, y, z, CASE WHEN y > 0 THEN y - 1 WHEN y < 0 THEN greatest(0, y + n) ELSE 0 END AS o, CASE WHEN y = 0 THEN 1 WHEN y < 0 AND -y > n THEN -y - n ELSE 0 END AS lost"
    return f"""(SELECT CASE WHEN y IS NULL THEN t WHEN z IS NULL THEN substr(t, CAST(o + 1 AS INT)) WHEN z < 0 THEN substr(t, CAST(o - least(o, -z) + 1 AS INT), CAST(least(o, -z, n) AS INT)) ELSE substr(t, CAST(o + 1 AS INT), CAST(greatest(0, z - lost) AS INT)) END
      FROM ({places} FROM (SELECT {whole} AS t, CAST({_LENGTH} AS BIGINT) AS n, y, z)))"""


_SQL_FUNCTIONS |= {
    f"nucleotides_twobit(s STRING) RETURNS {_TWOBIT}": _CODED,
    f"twobit_length(x {_TWOBIT}) RETURNS INT": _LENGTH,
    f"twobit_dna(x {_TWOBIT}, y BIGINT DEFAULT NULL, z BIGINT DEFAULT NULL) RETURNS STRING": _decoding("TCAG"),
    f"twobit_rna(x {_TWOBIT}, y BIGINT DEFAULT NULL, z BIGINT DEFAULT NULL) RETURNS STRING": _decoding("UCAG"),
    "engine_version() RETURNS STRING": f"'{__version__}'",
}


def register_functions(spark: SparkSession) -> None:
    """SQL functions of the scalar helpers and of JSON edits, and the table function json_tree."""
    pattern = r"^([^:\\-\\s]+):([0-9,]+)-([0-9,]+)\\z"
    for signature, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body.replace('{part}', _RANGE.replace('{p}', pattern))}")
    json_docs.register_json(spark)

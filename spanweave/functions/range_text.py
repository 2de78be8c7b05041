"""Range text such as ``chr1:2,345-6,789``: one-based and closed in text, zero-based half-open as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^([^:\-\s]+):([0-9,]+)-([0-9,]+)\z"
#: The largest position (fixed value).
MOST = 9223372036854775799


def _number(s: Column, group: int) -> Column:
    digits = F.regexp_replace(F.regexp_extract(s, PATTERN, group), ",", "")
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    value = F.when(digits == "", F.lit(0)).when(F.length(digits) <= 19, digits.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit(MOST), value.cast("bigint"))


def parse_range(s: Column | str) -> Column:
    """struct (sequence, begin, end); null for null, an error for text that is no range."""
    s = F.col(s) if isinstance(s, str) else s
    begin, end = _number(s, 2), _number(s, 3)
    good = s.rlike(PATTERN) & F.coalesce((begin >= 1) & (begin <= end), F.lit(False))
    kind = "struct<sequence: string, begin: bigint, end: bigint>"
    parts = F.struct(F.regexp_extract(s, PATTERN, 1).alias("sequence"), (begin - 1).alias("begin"), end.alias("end"))
    bad = F.raise_error(F.concat(F.lit("parse_genomic_range(): not a range: "), s)).cast(kind)
    return F.when(s.isNull(), F.lit(None).cast(kind)).when(good, parts).otherwise(bad)


def parse_genomic_range_sequence(s: Column | str) -> Column:
    return parse_range(s)["sequence"]


def parse_genomic_range_begin(s: Column | str) -> Column:
    return parse_range(s)["begin"]


def parse_genomic_range_end(s: Column | str) -> Column:
    return parse_range(s)["end"]

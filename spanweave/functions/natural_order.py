"""Natural order of names: runs of digits compare as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(s: Column | str) -> Column:
    """A text whose plain order, equality and grouping are the natural ones of `s`.

    Digit runs lose leading zeros and are led by their length, so runs of any
    length compare as numbers, and against other characters as digits do.
    """
    s = F.col(s) if isinstance(s, str) else s
    runs = F.regexp_extract_all(s, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(x)

    return F.when(s.isNotNull(), F.array_join(F.transform(runs, key), ""))

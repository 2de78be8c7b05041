"""Runs of identical texts by a range sort.

Rows are dealt by ranges of (fingerprint, doc_id, place in the input), so the
copies of one text, also under one doc_id, are spread over as many partitions
as they need, and sorted within a partition by (fingerprint, text, doc_id).  Identical texts then stand next to
each other, and a run is told by comparing each text with its predecessor's
whole content; a fingerprint only brings texts together and decides nothing.
The range bounds are drawn from keys of fixed size, never from texts.

Only the first fingerprint of a partition can go on from an earlier one, and
only the last can go on in a later one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Row(NamedTuple):
    fp: int
    doc_id: int | None
    text: bytes
    #: Whether the text differs from the predecessor's in this partition.
    starts: bool
    rest: tuple


def sorted_by_text(docs: DataFrame, *carry: Column) -> DataFrame:
    """Columns (fp, doc_id, text, ...carry), dealt and sorted as told above; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("fp"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), *carry, F.monotonically_increasing_id().alias("_place"))
    return rows.repartitionByRange("fp", "doc_id", "_place").drop("_place").sortWithinPartitions("fp", "text", "doc_id")


def rows_with_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    """The rows of one partition of `sorted_by_text`, each compared with its predecessor."""
    fp_before = text_before = None
    for batch in batches:
        fps, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        carried = list(zip(*[batch.column(k).to_pylist() for k in range(3, batch.num_columns)], strict=True)) or [()] * len(fps)
        for k, text in enumerate(batch.column(2)):
            now = text.as_py()
            starts = fps[k] != fp_before or now != text_before
            yield Row(fps[k], ids[k], now, starts, carried[k])
            fp_before, text_before = fps[k], now

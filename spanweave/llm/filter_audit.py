"""Filter interaction audit: what five filters remove in each of their 120 orders.

Exact duplicates are found by a sort (see text_runs): a text fails E when its
run holds a smaller doc_id.  A run that goes on from an earlier partition is
settled by a small table of the partitions' border runs.  The other four
conditions are read off the text while it is compared, once per run.

Everything the audit reports follows from how many documents of a part fail
each set of filters, so documents are reduced to a failure mask of five bits
and counted by (part, mask, labels): counters that add up in any order, at
most 32 masks by 4 label pairs for a part.  The 600 rows of a part are sums
over these counters.

Edge cases: a null text is empty; a null lang counts as the empty string; a
null doc_id is no smaller id for others and its row never fails E; rows that
repeat a doc_id and its text don't fail E by one another, and each counts;
repeated rows of labels count as one, which has a mark where any of them has;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged
from .text_runs import rows_with_starts, sorted_by_text

FILTERS = "ABCDE"
#: The bits of a failure mask, in the order of FILTERS.
A, B, C, D, E = (1 << k for k in range(5))
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
#: Every byte of UTF-8 that doesn't begin a code point.
_TRAILING = bytes(range(0x80, 0xC0))
_BATCH = 8192

_SCHEMA = pa.schema([("kind", pa.string()), ("fp", pa.int64()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32())])


def content_mask(text: bytes) -> int:
    """The filters A to D that a text in UTF-8 fails; bytes.split() parts at blank and 09 to 0D, as words are defined."""
    words = text.split()
    points = len(text.translate(None, _TRAILING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    mask = A if len(words) < MIN_WORDS else 0
    mask |= B if 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words) else 0
    mask |= C if 100 * capitals > MAX_CAPITAL_PERCENT * points else 0
    return mask | (D if _MARKS.search(text) else 0)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows 'closed' (the mask is final), 'open' (no smaller id in this partition, but maybe in an earlier one) and 'tail'.

    Tails are the texts that may go on in a later partition, with their
    smallest ids: as many as there are texts under the partition's last
    fingerprint, nearly always one.
    """
    out: list[tuple] = []
    head = mask = least = tail_fp = None
    tails: dict[bytes, int] = {}
    for row in rows_with_starts(batches):
        if head is None:
            head = row.fp
        if row.starts:
            mask, least = content_mask(row.text), None
            if row.fp != tail_fp:
                tail_fp, tails = row.fp, {}
        if least is None and row.doc_id is not None:
            tails[row.text] = least = row.doc_id
        later = row.doc_id is not None and row.doc_id > least
        if row.fp == head and row.doc_id is not None and not later:
            out.append(("open", row.fp, row.text, row.doc_id, row.rest[0], mask))
        else:
            out.append(("closed", None, None, row.doc_id, row.rest[0], mask | E if later else mask))
        if len(out) >= _BATCH:
            yield _batch(out)
            out = []
    out += [("tail", tail_fp, text, least, None, None) for text, least in tails.items()]
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def compared(docs: DataFrame) -> DataFrame:
    """What the tasks tell of their rows (see `_masked`), staged; `failure_masks` puts it together."""
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    told = sorted_by_text(docs, part).mapInArrow(_masked, "kind string, fp long, text binary, doc_id long, part string, mask int")
    return staged(told, "audit-rows")


def failure_masks(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask) from `compared`: one for each document, with the bits of the filters that it fails."""
    # One row for each border text, however many partitions it spans.
    borders = rows.filter("kind = 'tail'").groupBy(F.col("fp").alias("b_fp"), F.col("text").alias("b_text")).agg(F.min("doc_id").alias("least"))
    heads = rows.filter("kind = 'open'")
    settled = heads.join(borders, (heads.fp == borders.b_fp) & (heads.text == borders.b_text), "left")
    settled = settled.select("doc_id", "part", F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(E))).otherwise(F.col("mask")).alias("mask"))
    return rows.filter("kind = 'closed'").select("doc_id", "part", "mask").unionByName(settled)


def failure_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Additive counters (part, mask, n, n_good, n_toxic) of `failure_masks`."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows of one doc_id meet as counts, so that a repeated id is no hot key of the join.
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = lambda name: F.coalesce(F.sum(F.when(F.col(name), F.col("n"))), F.lit(0)).alias(f"n_{name}")
    return rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def _steps() -> Column:
    """The 600 pairs of order and step, with the bits of the step's filter and of those before it."""
    steps = []
    for order in itertools.permutations(range(5)):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            steps.append(f"struct('{name}' AS filter_order, {step} AS step, {1 << k} AS bit, {before} AS before)")
            before |= 1 << k
    return F.expr(f"array({', '.join(steps)})")


def order_report(counters: DataFrame) -> DataFrame:
    """The rows of the audit: 600 for each part, from the at most 32 counters of each."""
    parts = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("counters"))
    rows = parts.select("part", "counters", F.explode(_steps()).alias("s")).select("part", "counters", "s.*")
    hit, earlier = "c.mask & bit <> 0", "c.mask & before <> 0"
    total = lambda what, when: F.expr(f"aggregate(counters, 0L, (a, c) -> a + CASE WHEN {when} THEN {what} ELSE 0L END)")
    # In 120 orders each of the filters that a document fails comes first among them equally often.
    shares = F.expr("aggregate(counters, 0L, (a, c) -> a + CASE WHEN " + hit + " THEN c.n * (120 div greatest(bit_count(c.mask), 1)) ELSE 0L END)")
    return rows.select(
        "part", "filter_order", "step",
        total("c.n", "c.mask & (before | bit) = 0").alias("kept"),
        total("c.n", f"{hit} AND NOT {earlier}").alias("removed"),
        total("c.n", f"{hit} AND {earlier}").alias("redundant"),
        total("c.n", "c.mask = bit").alias("unique_fails"),
        total("c.n_good", f"{hit} AND NOT {earlier}").alias("good_lost"),
        total("c.n_toxic", f"{hit} AND NOT {earlier}").alias("toxic_lost"),
        shares.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    rows = compared(docs)
    counters = staged(failure_counters(failure_masks(rows), labels), "audit-counters")
    discard(rows)
    return order_report(counters)

"""Mixing sources to target weights by temperature, as budgeted block permutations.

A source with share p of all tokens gets a weight in proportion to p ** a.
The exponent a lies in [0, 1] on a grid of 1e-6 and is found by section: the
largest a whose entropy reaches the target, or, where a repetition limit is
given and binds, the least a at which no source is read more often than the
limit.  Each step is one aggregate over the table of sources, whose sums for
all section points come back in a single row.

A source's weight times the token budget gives its allotment: as many whole
passes over the source as fit, then part of one more.  Each pass is a
permutation of the source cut into blocks: a hash of (seed, pass, doc_id)
deals documents to blocks of about BLOCK_ROWS and orders them within.  The
partial pass takes blocks from the first until the allotment is used up, and
the last of them document by document; block totals are aggregated first, so
no window spans more than one block's documents or one source's blocks.

Edge cases: a null source is a source of its own; a null or empty text has no
tokens, costs nothing and is in every whole pass; a source without any tokens
has no weight and is read once; repeated rows are documents like any other;
a null doc_id hashes as an empty name; an empty table gives an empty result;
columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import staged

GRID = 1_000_000
BLOCK_ROWS = 2048
SECTIONS = 32
SEED = 17


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens): words between white space."""
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words).cast("long").alias("n_tokens"))


def _entropies(sources: DataFrame, points: list[int]) -> list[tuple[float, float]]:
    """(entropy, largest weight over share) at each exponent point / GRID."""
    shares = sources.filter("tokens > 0").crossJoin(sources.agg(F.sum("tokens").alias("total")).hint("broadcast")).select((F.col("tokens") / F.col("total")).alias("p"))
    sums = []
    for i, k in enumerate(points):
        w = F.pow("p", F.lit(k / GRID))
        sums += [F.sum(w).alias(f"z{i}"), F.sum(w * (k / GRID) * F.log("p")).alias(f"l{i}"), F.max(w / F.col("p")).alias(f"r{i}")]
    row = shares.agg(*sums).first()
    out = []
    for i in range(len(points)):
        z = row[f"z{i}"]
        out.append((math.log(z) - row[f"l{i}"] / z, row[f"r{i}"] / z) if z else (0.0, 0.0))
    return out


def _largest(sources: DataFrame, holds) -> int:
    """The largest k in 0..GRID for which `holds` is true of its figures, given that it is true up to some k; 0 if of none."""
    lo, hi = 0, GRID
    while True:
        points = sorted({lo + (hi - lo) * i // SECTIONS for i in range(SECTIONS + 1)})
        good = [k for k, figures in zip(points, _entropies(sources, points), strict=True) if holds(*figures)]
        if not good:
            return 0
        lo, above = max(good), [k for k in points if k > max(good)]
        if not above or above[0] == lo + 1:
            return lo
        hi = above[0]


def exponent(sources: DataFrame, flatten: float = 0.5, budget_share: float = 1.0, repeat_limit: float | None = 4.0) -> float:
    """The exponent for a table (source, tokens).

    The target entropy lies `flatten` of the way from the natural mix (0) to
    equal weights (1).  With a budget of `budget_share` times all tokens, no
    source may be read more than `repeat_limit` times, even if the entropy
    then stays below its target.
    """
    ends = _entropies(sources, [0, GRID])
    (most, _), (least, _) = ends
    target = least + flatten * (most - least)
    k = _largest(sources, lambda entropy, _: entropy >= target)
    if repeat_limit is not None:
        held = lambda r: budget_share * r <= repeat_limit
        (_, now), = _entropies(sources, [k])
        if not held(now):
            k = min(GRID, _largest(sources, lambda _, r: not held(r)) + 1)
    return k / GRID


def _draw(rep: Column) -> Column:
    """A number below 2^60 from (seed, pass, doc_id), the same on every engine that has md5."""
    name = F.concat_ws(":", F.lit(str(SEED)), rep.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, flatten: float = 0.5, budget_share: float = 1.0, repeat_limit: float | None = 4.0, salts: int = 16) -> DataFrame:
    """Rows (doc_id, source, pass, block, slot, n_tokens): the mixed corpus, one row for each time a document is read."""
    counted = staged(token_counts(docs), "mixing-tokens")
    sources = staged(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mixing-sources")
    a = exponent(sources, flatten, budget_share, repeat_limit)
    sums = sources.filter("tokens > 0").agg(F.sum("tokens").alias("total")).first()
    total = sums["total"] or 1
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(weight).alias("z")).first()["z"] or 1.0
    allotment = F.floor(weight / F.lit(z) * F.lit(total * budget_share)).cast("long")
    plan = sources.withColumn("allotment", allotment).select(
        F.col("source").alias("s"),
        F.when(F.col("tokens") > 0, F.floor(F.col("allotment") / F.col("tokens"))).otherwise(1).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("allotment") % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
        F.greatest(F.expr(f"n_docs div {BLOCK_ROWS}"), F.lit(1)).cast("int").alias("blocks"),
    )
    # Each source's row is there `salts` times, so that a large source meets it in as many tasks.
    plan = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(salts)).cast("int"))
    joined = salted.join(plan, salted.source.eqNullSafe(plan.s) & (F.col("salt") == F.col("part")))
    passes = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole")))).filter("pass < whole or rest > 0")
    dealt = passes.withColumn("draw", _draw(F.col("pass"))).withColumn("block", F.pmod(F.col("draw"), F.col("blocks")).cast("int"))
    dealt = staged(dealt.select("doc_id", "source", "n_tokens", "pass", "block", "draw", "whole", "rest"), "mixing-dealt")
    totals = dealt.filter("pass = whole").groupBy("source", "block").agg(F.sum("n_tokens").alias("held"), F.max("rest").alias("b_rest"))
    ordered = Window.partitionBy("source").orderBy("block")
    starts = totals.withColumn("start", F.sum("held").over(ordered) - F.col("held")).filter("start <= b_rest").select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "start")
    within = Window.partitionBy("source", "pass", "block").orderBy("draw", "doc_id", "n_tokens")
    slots = dealt.withColumns({"slot": F.row_number().over(within), "upto": F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    on = slots.source.eqNullSafe(starts.b_source) & (F.col("block") == F.col("b_block")) & (F.col("pass") == F.col("whole"))
    kept = slots.join(starts, on, "left").filter((F.col("pass") < F.col("whole")) | (F.col("start") + F.col("upto") <= F.col("rest")))
    return kept.select("doc_id", "source", "pass", "block", "slot", "n_tokens")

"""Quality rules with adaptive thresholds.

Base counts of every text come from SQL functions alone.  From them follow
four ratios; a mergeable quantile sketch of each ratio is kept per
(lang, source), and a document is rejected when a ratio lies outside the
fences of its group.  A fence is the quartile by so many interquartile ranges
and a slack that keeps a uniform group from rejecting its own members.  Ratios
that are 0 in most documents have quartiles of 0, so their upper fence is the
group's TAIL quantile with one bucket more, where that is less; without `tails`
it is the quartile fence alone.

The sketch is a histogram with integer buckets (width 1 up to 64, then 64
buckets per power of two: relative error below 1/64).  Two sketches merge by
adding counts, in any order, so partial aggregation builds them before the
shuffle and results don't depend on how rows were dealt out.  A group's
quantiles are drawn towards those of its language, and these towards those of
all documents, by the weight of `prior` documents: small groups borrow, and
nothing jumps as a group grows.

Edge cases: a null or empty text has zero counts and fails the base rule;
null lang or source form a group of their own; repeated rows are judged each
for itself and each counts in the sketch; an empty table gives an empty
result; further columns pass through `quality_verdicts` untouched, and the
operator's own columns replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

#: Quartile fences: reach in interquartile ranges, and the slack in the ratio's own unit.
#: name -> (expression, reach, slack below or None, slack above or None)
RATIOS = {
    "symbol_permille": ("1000 * n_symbols div greatest(word_chars, 1)", 3, None, 80),
    "dup_line_permille": ("1000 * n_dup_lines div greatest(n_lines, 1)", 3, None, 400),
    "repeat_permille": ("1000 * n_repeat_words div greatest(n_words, 1)", 3, None, 300),
    "word_length_tenths": ("10 * word_chars div greatest(n_words, 1)", 6, 15, 60),
}
#: The upper quantile (permille) that bounds the sparse ratios with `tails`.
TAIL = 990
SPARSE = ("symbol_permille", "dup_line_permille", "repeat_permille")
#: How many documents the wider group counts for in a group's quantiles.
PRIOR = 200
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Words are runs of characters outside blank, tab, line feed, vertical tab,
    form feed and carriage return.  n_repeat_words counts the words inside
    8-word windows that occur twice or more, by 64-bit hashes of the windows
    within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.drop(*_COUNTS).withColumns({"_w": words, "_l": lines})
    starts = F.sequence(F.lit(1), F.size("_w") - 7)
    windows = F.when(F.size("_w") >= 8, F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, 8))))
    counted = counted.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.coalesce(windows, F.array().cast("array<bigint>")),
    }).drop("_w", "_l")
    counted = counted.withColumn("_again", F.size("_h") > F.size(F.array_distinct("_h")))
    return counted.withColumn("n_repeat_words", F.when(~F.col("_again"), F.lit(0)).otherwise(_covered(F.col("_h"))).cast("long")).drop("_h", "_again")


def _covered(hashes: Column) -> Column:
    """Words inside the windows whose hash occurs twice or more."""
    entries = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    shifted = F.arrays_zip(
        entries.alias("e"),
        F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.slice(entries, 1, F.size(entries) - 1), lambda x: x["h"])).alias("before"),
        F.concat(F.transform(F.slice(entries, 2, F.size(entries)), lambda x: x["h"]), F.array(F.lit(None).cast("bigint"))).alias("after"),
    )
    twice = F.filter(shifted, lambda z: (z["e"]["h"] == z["before"]) | (z["e"]["h"] == z["after"]))
    at = F.array_sort(F.transform(twice, lambda z: z["e"]["i"]))
    state = F.struct(F.lit(0).alias("words"), F.lit(-8).alias("last"))
    step = lambda acc, i: F.struct((acc["words"] + F.least(F.lit(8), i - acc["last"])).alias("words"), i.alias("last"))
    return F.aggregate(at, state, step, lambda acc: acc["words"])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _shift(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - 7, F.lit(0))


def bucket(value: Column) -> Column:
    """The lower end of the sketch bucket of a non-negative long."""
    shift = _shift(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def ratio_sketches(counts: DataFrame) -> DataFrame:
    """Rows (lang, source, ratio, bucket, n): the sketches of each group's sound documents."""
    entries = F.array(*[F.struct(F.lit(name).alias("ratio"), bucket(F.expr(rule)).alias("bucket")) for name, (rule, *_) in RATIOS.items()])
    return counts.filter(~base_failed()).select("lang", "source", F.explode(entries).alias("e")).groupBy("lang", "source", "e.ratio", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, ratio, size, q1, q3, tail) read off the sketches."""
    by = Window.partitionBy(*keys, "ratio")
    upto = F.sum("n").over(by.orderBy("bucket"))
    ranked = sketches.select(*keys, "ratio", "bucket", upto.alias("upto"), F.sum("n").over(by).alias("size"))
    first = lambda share: F.min(F.when(1000 * F.col("upto") >= share * F.col("size"), F.col("bucket")))
    return ranked.groupBy(*keys, "ratio").agg(F.max("size").alias("size"), first(250).alias("q1"), first(750).alias("q3"), first(TAIL).alias("tail"))


def adaptive_fences(sketches: DataFrame, prior: int = PRIOR, tails: bool = True) -> DataFrame:
    """Rows (lang, source, <ratio>_low, <ratio>_high) for every group that has sketches."""
    marks = ("q1", "q3", "tail")
    own = quartiles(sketches, "lang", "source")
    by_lang = quartiles(merged(sketches, "lang"), "lang").select(F.col("lang").alias("l"), F.col("ratio").alias("lr"), F.col("size").alias("l_size"), *[F.col(q).alias(f"l_{q}") for q in marks])
    overall = quartiles(merged(sketches)).select(F.col("ratio").alias("ar"), *[F.col(q).alias(f"a_{q}") for q in marks])
    levels = own.join(by_lang, (own.lang.eqNullSafe(by_lang.l)) & (own.ratio == by_lang.lr)).join(overall, F.col("ratio") == F.col("ar"))
    levels = levels.withColumns({f"l_{q}": F.expr(f"(l_size * l_{q} + {prior} * a_{q}) div (l_size + {prior})") for q in marks})
    levels = levels.select("lang", "source", "ratio", *[F.expr(f"(size * {q} + {prior} * l_{q}) div (size + {prior})").alias(q) for q in marks])
    fences = []
    for name, (_, reach, below, above) in RATIOS.items():
        own_ratio = F.col("ratio") == name
        spread = reach * (F.col("q3") - F.col("q1"))
        if below is not None:
            fences.append(F.max(F.when(own_ratio, F.col("q1") - spread - below)).alias(f"{name}_low"))
        if above is not None:
            high = F.col("q3") + spread + above
            if tails and name in SPARSE:
                high = F.least(high, F.col("tail") + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(F.col("tail"))))
            fences.append(F.max(F.when(own_ratio, high)).alias(f"{name}_high"))
    return levels.groupBy("lang", "source").agg(*fences)


def quality_verdicts(docs: DataFrame, prior: int = PRIOR, salts: int = 16, tails: bool = True) -> DataFrame:
    """`docs` with the base counts, base_failed and kept.

    The text is read once: the counts are staged without it.  The fences
    table (a row per group) is joined back with `salts` copies of each row,
    so a source that holds a third of all rows is spread over as many tasks
    where the table is too large to be sent to all.
    """
    carried = [c for c in docs.columns if c not in {"text", "base_failed", "kept", *_COUNTS}]
    counts = staged(base_counts(docs.select("text", *carried)).drop("text"), "quality-counts")
    fences = adaptive_fences(ratio_sketches(counts), prior, tails)
    fences = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"}).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in ("doc_id", "n_words", "word_chars") if c in counts.columns]), F.lit(salts)).cast("int"))
    on = salted.lang.eqNullSafe(fences._lang) & salted.source.eqNullSafe(fences._source) & (F.col("_salt") == F.col("_part"))
    joined = salted.join(fences, on, "left")
    inside = F.lit(True)
    for name, (rule, _, below, above) in RATIOS.items():
        if below is not None:
            inside = inside & F.coalesce(F.expr(rule) >= F.col(f"{name}_low"), F.lit(True))
        if above is not None:
            inside = inside & F.coalesce(F.expr(rule) <= F.col(f"{name}_high"), F.lit(True))
    return joined.select(*carried, *_COUNTS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))

"""Fences by upper quantiles of sparse ratios against brute force."""

from pyspark.sql import functions as F

from spanweave.llm import quality_rules


def text(k, repeated=0, dup_lines=0, symbols=0):
    """90 words of 5 characters and more, of which `repeated` stand in 8-word windows that occur twice."""
    words = [f"word{k}x{i}" for i in range(90 - repeated)]
    words += words[:repeated]
    lines = [" ".join(words[i : i + 10]) for i in range(0, 90, 10)] + ["end"] * (dup_lines + 1)
    return "\n".join(lines) + "#" * symbols


def documents(spark):
    rows = []
    for lang, source, n, often in (("en", "a", 300, 40), ("en", "b", 300, 1), ("en", "c", 30, 0), ("fr", "a", 40, 0), (None, None, 250, 2)):
        for k in range(n):
            marked = k < often
            rows.append((len(rows), text(len(rows), repeated=10 if marked else 0, dup_lines=3 if k == 5 or marked else 0, symbols=20 if k == 7 else 0), lang, source))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def brute(counts, tails):
    ratios = {
        "symbol_permille": (lambda r: 1000 * r.n_symbols // max(r.word_chars, 1), 80), "dup_line_permille": (lambda r: 1000 * r.n_dup_lines // max(r.n_lines, 1), 400),
        "repeat_permille": (lambda r: 1000 * r.n_repeat_words // max(r.n_words, 1), 300),
    }
    bucket = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    sound = [r for r in counts if not r.base_failed]
    kept = set()
    for r in sound:
        wider = ([x for x in sound if (x.lang, x.source) == (r.lang, r.source)], [x for x in sound if x.lang == r.lang], sound)
        inside = True
        for value, slack in ratios.values():
            held = [sorted(bucket(value(x)) for x in group) for group in wider]

            def at(share):
                own, lang, all_ = (h[-(-share * len(h) // 1000) - 1] for h in held)  # noqa: B023
                n, m = len(held[0]), len(held[1])  # noqa: B023
                return (n * own + 200 * ((m * lang + 200 * all_) // (m + 200))) // (n + 200)

            fence = at(750) + 3 * (at(750) - at(250)) + slack
            if tails:
                fence = min(fence, at(990) + (1 << max(at(990).bit_length() - 7, 0)))
            inside &= value(r) <= fence
        if inside:
            kept.add(r.doc_id)
    return kept


def test_tails_follow_each_group(spark):
    docs = documents(spark)
    kept = {}
    for tails in (False, True):
        rows = quality_rules.quality_verdicts(docs, tails=tails).collect()
        kept[tails] = {r.doc_id for r in rows if r.kept}
        assert kept[tails] == brute(rows, tails) and not any(r.base_failed for r in rows)
    # The same ratios are kept in the first group and rejected in another.
    # A passage said twice and repeated lines are usual in the first group and stand out in the others.
    assert len(kept[False]) == docs.count() and kept[True] < kept[False]
    rejected = {r.doc_id for r in docs.collect()} - kept[True]
    assert 300 in rejected and not rejected & (set(range(40)) - {7})


def test_every_sparse_fence_can_fire(spark):
    counts = quality_rules.base_counts(documents(spark))
    fences = quality_rules.adaptive_fences(quality_rules.ratio_sketches(counts), tails=True)
    row = fences.agg(*[F.min(f"{name}_high").alias(name) for name in quality_rules.SPARSE], F.countDistinct("repeat_permille_high").alias("n")).first()
    assert row.symbol_permille < 80 and row.dup_line_permille < 400 and row.repeat_permille < 300 and row.n > 1

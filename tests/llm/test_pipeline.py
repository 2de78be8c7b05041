"""The stages of the pipeline work on each other's rows."""

import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from spanweave.llm import mixing, quality_rules
from spanweave.llm.storage import staged, table

SMALL = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = staged(table(spark, SMALL, "documents"), "t")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SMALL), "t")
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.DOCUMENT)
            assert docs.join(before, list(corpus_pipeline.DOCUMENT), "left_anti").isEmpty()
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.quality_verdicts(before).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "ngram_jaccard_join":
            assert docs.select("text").distinct().count() == docs.count() < before.count()
    assert counts[1] < counts[0] and counts[-1] == counts[-2] > 0
    assert docs.filter(F.size("pieces") > 0).count() == docs.count()


def row(i, text, lang="en", source="s", n=1):
    return (i, text, lang, source, n)


def prose(seed, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(words))


def test_null_and_repeated_ids(spark):
    """Rows are judged by their own texts, whatever their ids; none is lost and of each group one stays."""
    kept, copy = [prose(i) for i in range(8)], prose(0) + " more"
    rows = [row(1, kept[0]), row(1, kept[1]), row(1, "short"), row(None, kept[2]), row(None, kept[3], None, None, None), row(2, kept[4]), row(2, kept[4]), row(None, copy), row(None, kept[5]), row(None, kept[5]), row(3, None), row(4, ""), row(5, "x" * 30_000)]
    docs = staged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "t")
    ruled = staged(corpus_pipeline.rules_stage(spark, docs, SMALL), "t")
    assert ruled.count() == 9 and ruled.filter("text = 'short' or text is null or text = ''").isEmpty()
    once = staged(corpus_pipeline.duplicates_stage(spark, docs, SMALL), "t")
    assert sorted(r.text or "" for r in once.collect()) == sorted(["", "", "short", "x" * 30_000, *kept[:6]])
    assert {r.doc_id for r in once.filter(F.col("text") == kept[0]).collect()} == {1}
    mixed = staged(corpus_pipeline.mixing_stage(spark, docs, SMALL), "t")
    assert mixed.columns == list(corpus_pipeline.DOCUMENT) and mixed.count() == mixing.mix(docs.withColumn("doc_id", F.xxhash64(*docs.columns))).count()
    assert mixed.filter("doc_id is null").count() >= 4
    scored = staged(corpus_pipeline.classifier_stage(spark, docs, SMALL), "t")
    assert scored.columns == list(corpus_pipeline.DOCUMENT)
    assert corpus_pipeline.pieces_stage(spark, mixed, SMALL).count() == mixed.count()


def test_empty_tables(spark):
    docs = staged(table(spark, SMALL, "documents").filter("false"), "t")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")}
    assert set(__spark_entry__.oracle_sql()) <= set(names)

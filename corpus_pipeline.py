"""The corpus pipeline: quality rules, quality classifier, near duplicates, mixing, pieces.

Each stage takes what its predecessor kept (the columns of documents) and the
last returns the pieces of each text.  A stage names rows by a hash of all
their columns, so null and repeated doc_ids are judged by their own texts, and
rows that are equal in every column share their verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import mixing, ngram_join, quality_gbt, quality_rules, unigram
from spanweave.llm.storage import staged, table, tokenizer_path

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Verdicts are sent to all tasks while they number at most this many, else both sides are shuffled.
BROADCAST_ROWS = 500_000


def _named(verdicts: DataFrame) -> DataFrame:
    """Staged verdicts of a few numbers each, marked for broadcast only behind a count."""
    rows = staged(verdicts, "pipeline-verdicts")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a name for each distinct row."""
    return docs.withColumn("_row", F.xxhash64(*DOCUMENT))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The keyed `docs` less the rows named in `rejected`."""
    return docs.join(_named(rejected.select("_row").distinct()), "_row", "left_anti").select(*DOCUMENT)


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The keyed `docs`, with one row for each name in `repeated`; only such rows are shuffled."""
    single = docs.join(repeated, "_row", "left_anti")
    return single.unionByName(docs.join(repeated, "_row", "left_semi").dropDuplicates(["_row"]))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go."""
    docs = _keyed(docs)
    return _without(docs, quality_rules.quality_verdicts(docs).filter(~F.col("kept")))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees predict to be of low quality go."""
    docs = _keyed(docs)
    return _without(docs, quality_gbt.quality_scores(docs, table(spark, sf_dir, "labels"), carry=("_row",)).filter("predicted = 0"))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest doc_id, a row with a null one only where no other is.

    Texts without words are no copies of each other and all stay.
    """
    docs = _keyed(docs)
    groups = ngram_join.jaccard_components(docs.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id", "n_shingles")
    groups = staged(groups.filter("n_shingles > 0").groupBy("_row").agg(F.max("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")), "pipeline-groups")
    named = groups.join(docs.select("_row", F.col("doc_id").alias("id")).distinct(), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("first"))
    rest = groups.join(first, "component_id").filter("_row <> first._row")
    left = _keyed(_without(docs, rest))
    return _once(left, _named(groups.filter("rows > 1").select("_row"))).select(*DOCUMENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are there as often as the mix reads them: not at all, once or several times."""
    docs = _keyed(docs)
    reads = _named(mixing.mix(docs.withColumn("doc_id", F.col("_row"))).groupBy(F.col("doc_id").alias("_row")).agg(F.count(F.lit(1)).cast("int").alias("reads")))
    # Rows equal in every column are read together: one of them stands for all their reads.
    repeated = _named(docs.groupBy("_row").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("_row"))
    mixed = _once(docs, repeated).join(reads, "_row")
    return mixed.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("reads")))).select(*DOCUMENT)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of each text."""
    vocabulary = unigram.shared_vocabulary(spark, tokenizer_path("piece_bpe_32k.model"))
    return unigram.with_pieces(docs.select("doc_id", "lang", "source", "text"), vocabulary).drop("text")


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("ngram_jaccard_join", duplicates_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: The classifier and the pieces can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs

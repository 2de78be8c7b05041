"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, fill_in_middle, filter_audit, html_density, mixing, ngram_join, nn_descent, quality_gbt, quality_rules, token_counts, tool_calls, toxicity_cnn, unigram
from .oracle import ORACLE
from .storage import table, tokenizer_path


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of_messages(table(spark, sf_dir, "conversations"))
    return _digested(tool_calls.linked_calls(calls, results, tool_calls.REPLY_TOOL))


def _digested(linked: DataFrame) -> DataFrame:
    # The digest of the canonical text stands for it, and -1 for a turn or level that isn't there.
    filled = {c: F.coalesce(c, F.lit(-1)) for c in ("call_turn", "result_turn", "level")}
    return linked.withColumns(filled | {"canonical_md5": F.md5(F.col("canonical").cast("binary"))}).drop("canonical")


def tool_calls_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op1 from messages that carry the same calls and results as JSON."""
    asked, answers = tool_calls.calls_of_messages(table(spark, sf_dir, "conversations"))
    call = F.struct(F.col("call_id").alias("id"), "name", F.from_json("arguments", "text string, n_chars int, style string").alias("arguments"), "needs")
    messages = asked.select("conv_id", "turn", F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    messages = messages.unionByName(answers.select("conv_id", "turn", F.to_json(F.struct(F.col("call_id").alias("tool_call_id"), "content")).alias("text")))
    return _digested(tool_calls.linked_calls(*tool_calls.calls_of_json(messages), tool_calls.REPLY_TOOL))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("edits", token_counts.derived_edits())
    return token_counts.edited_counts(docs, token_counts.shared_ranks(spark, tokenizer_path("byte_bpe_50k.tiktoken")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = unigram.shared_vocabulary(spark, tokenizer_path("piece_bpe_32k.model"))
    return unigram.piece_digest(table(spark, sf_dir, "documents"), vocabulary)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, under the name of the tail fences before they were the operator's own."""
    return op8_quality_rules(spark, sf_dir)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_text(table(spark, sf_dir, "pages"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.bpe_digest(table(spark, sf_dir, "documents"), bpe_automaton.shared_automaton(spark, tokenizer_path("byte_bpe_50k.json")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), digests=True).select(*fill_in_middle.digest_columns())


_ALL = (
    op1_tool_call_linking, tool_calls_of_json, op2_ngram_jaccard_join, op3_nearest_neighbours, op4_toxicity, op5_quality_classifier,
    op6_edit_aware_token_counts, op7_sentencepiece, op8_quality_rules, op8_quality_tails,
    op9_source_mixing, op10_html_extraction, op11_filter_interaction_audit, op12_bpe_automaton, op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

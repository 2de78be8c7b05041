"""The toxicity model, its calibration and its thresholds come from all labelled rows."""

import numpy as np
from pyspark.sql import functions as F

from spanweave.llm import toxicity_cnn


def test_rare_words_of_many_labelled_rows_are_learnt(spark, monkeypatch):
    """Each toxic word stands in two of 7000 toxic texts, so a sample of the toxic rows can't know them all."""
    rng = np.random.default_rng(2)
    texts = []
    for k in range(14_000):
        mark = f"vile{(k // 2) % 3500}" if k % 2 == 0 else f"kind{(k // 2) % 3500}"
        texts.append((k, " ".join([*(f"w{x}" for x in rng.integers(0, 50, 6)), mark]), "en"))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity_cnn, "SHARD_ROWS", 4000, raising=False)
    scores = toxicity_cnn.toxicity_scores(docs, labels).filter("not held_out").toPandas()
    right = (scores.predicted == (scores.doc_id % 2 == 0)).mean()
    assert right >= 0.95, right


def test_every_labelled_row_reaches_the_fit(spark):
    docs = spark.createDataFrame([(k, "a b c " * (200_000 if k == 3 else 1), None) for k in range(9000)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    rows, toxic, others = toxicity_cnn.learning_rows(docs, labels, 4, 2)
    want = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).count()
    assert rows.count() == want == toxic + others and rows.agg(F.max(F.size("words"))).first()[0] == 600_000

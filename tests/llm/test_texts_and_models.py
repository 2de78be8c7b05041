"""Pieces, counts, pages, classifiers and the neighbour graph."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.llm import html_density, nn_descent, quality_gbt, token_counts, toxicity_cnn, unigram, wordhash
from spanweave.llm.storage import crc_mod, hash_sample, staged, table, tokenizer_path

SMALL = "/root/testdata/sf0.01"


def test_word_hashes_follow_words():
    texts = ["Ab cd\tab", None, "", "cd", "é é", " " * 10, "x" * 9000 + " " + "x" * 9001, "cd"]
    got = [s.hashes[a:b] for s in wordhash.hashed_slices(pa.array(texts)) for a, b in zip(s.word_at, s.word_at[1:], strict=False)]
    assert [len(x) for x in got] == [3, 0, 0, 1, 2, 0, 2, 1]
    assert got[0][0] == got[0][2] and got[0][1] == got[3][0] == got[7][0] and got[4][0] == got[4][1] and got[6][0] != got[6][1]
    assert got[0][1] == [s.hashes[-1] for s in wordhash.hashed_slices(pa.array(["y" * 9000 + " cd"]))][0]
    assert sum(s.rows for s in wordhash.hashed_slices(pa.array(["word " * 100] * 50).slice(7, 40))) == 40


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.read_vocabulary(tokenizer_path("piece_bpe_32k.model"))


def best_score(codec, text):
    """The best score by plain dynamic programming over all substrings."""
    pieces = {s: i for i, s in enumerate(codec.v.surface) if np.isfinite(codec.score[i])}
    t = (" " + text).replace("▁", " ")
    best = [0.0] + [-np.inf] * len(t)
    for end in range(1, len(t) + 1):
        for start in range(max(0, end - 16), end):
            i = pieces.get(t[start:end].encode())
            if i is not None:
                best[end] = max(best[end], best[start] + codec.score[i])
        if pieces.get(t[end - 1 : end].encode()) is None:
            best[end] = max(best[end], best[end - 1] + codec.v.unknown)
    return best[-1]


def test_pieces_are_best_and_round_trip(vocabulary):
    rng = random.Random(4)
    codec = unigram.Codec(vocabulary)
    known = {s for i, s in enumerate(codec.v.surface) if np.isfinite(codec.score[i])}
    alphabet = ["the", "an", "ing", " ", " ", "é", "漢", "😀", "\n", ".", ",", "x", "Q", "9", "  ", "\x00", "("]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        byte = set(codec.v.byte_ids)
        unknown = sum(1 for c in text if c not in " ▁" and c.encode() not in known)
        score = sum(codec.score[i] for i in ids if i not in byte) + unknown * codec.v.unknown
        assert score == pytest.approx(best_score(codec, text))
    assert codec.encode("").tolist() == codec.encode(None).tolist() == [] and codec.decode(np.array([-1, 10**6], np.int32)) == ""


def test_piece_columns(spark):
    shared = unigram.shared_vocabulary(spark, tokenizer_path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, "a b", "clash"), (2, None, "x"), (None, "", "y"), (1, "a b", "clash")], "doc_id bigint, text string, pieces string")
    rows = unigram.with_pieces(docs, shared)
    assert rows.columns == ["doc_id", "text", "pieces"] and rows.count() == 4
    assert sorted((r.text or "") for r in unigram.decoded(rows, shared).collect()) == ["", "", "a b", "a b"]
    assert unigram.piece_digest(docs, shared).filter("round_trip").count() == 4
    assert unigram.piece_digest(docs.filter("false"), shared).count() == 0


@pytest.fixture(scope="module")
def count():
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        return token_counts.counter(f.read())[0]


def test_edits_count_like_a_full_encoding(count):
    rng = random.Random(2)
    bits = [" ", "a", "é", "\n", "'", "s", "1", ".", "\t", " x", "  ", "\x1c", "'ll"]
    for base in ("", " ", "a b c d " * 200, "\n\n  x" * 60, "x" * 3000, "It's 2024, isn't it? " * 40):
        tree, text = token_counts.SegmentTree(base, count, 24), base
        for _ in range(25):
            pos, removed, added = rng.randint(-2, len(text) + 2), rng.choice([0, 1, 3, 90]), "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 4, 150])))
            tree.edit(pos, removed, added)
            at = min(max(pos, 0), len(text))
            text = text[:at] + added + text[at + min(removed, len(text) - at) :]
            assert tree.text == text and tree.total == count([text])[0]


def test_edits_touch_little(count):
    """A hundred edits, scattered, at one place, after a large insertion and after a large deletion."""
    rng = random.Random(4)
    tree = token_counts.SegmentTree("some plain words follow " * 4000, count)
    for place in (lambda: rng.randrange(tree.chars[1]), lambda: 50_000):
        for _ in range(100):
            before, added = tree.encoded, rng.choice(["other", " x y", "\n", ""])
            tree.edit(place(), 3, added)
            assert tree.encoded - before < 600
        tree.edit(50_000, 0, " much new text" * 3000)
    tree.edit(1000, tree.chars[1] - 2000, "")
    before = tree.encoded
    tree.edit(500, 1, "y")
    assert tree.encoded - before < 600 and tree.total == count([tree.text])[0]


def test_edited_counts_of_tables(spark):
    ranks = token_counts.shared_ranks(spark, tokenizer_path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "a b", [(0, 0, "c ")], "clash", 7)] * 2, f"doc_id bigint, text string, edits {token_counts.EDITS}, n_tokens string, n_edits int")
    assert [tuple(r)[:4] for r in token_counts.edited_counts(docs, ranks).collect()] == [(1, 2, 3, 5)] * 2
    assert token_counts.edited_counts(docs.filter("false"), ranks).count() == 0


def test_edited_counts_edge_cases(spark):
    ranks = token_counts.shared_ranks(spark, tokenizer_path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(1, None, [(0, 0, "ab")]), (2, "a b", None), (3, "", []), (4, "a b", [(None, None, None), (99, 5, "!")])], f"doc_id bigint, text string, edits {token_counts.EDITS}")
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited, r.n_edits) for r in token_counts.edited_counts(docs, ranks).collect()}
    assert got == {1: (0, 1, 1), 2: (2, 2, 0), 3: (0, 0, 0), 4: (2, 3, 2)}


def test_main_text():
    body = "<p>First &amp; long paragraph of the article text that goes on.</p><p>Second\n one, with <b>bold</b> and <a href='x'>a link</a> inside of it.</p>"
    page = f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>Home</a></nav><div class='sidebar'>side</div><div id=main><h1>Head</h1>{body}</div><div class=\"comment-list\"><p>me too</p></div><footer>f</footer>"
    expected = "Head\nFirst & long paragraph of the article text that goes on.\nSecond one, with bold and a link inside of it."
    assert html_density.main_text(page) == expected
    assert html_density.main_text(page.replace("</p>", "").replace("</div><div class", "</div><div class")) == expected
    assert html_density.main_text(None) == html_density.main_text("") == "" and html_density.main_text("plain <text") == "plain"  # it breaks off inside a tag
    assert html_density.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert html_density.main_text("<!-- <p>no</p> --><p>yes") == "yes" and html_density.main_text('<p class="unclosed>x</p>') is not None


def test_pages_keep_the_article(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    got = html_density.extract_text(table(spark, SMALL, "pages")).collect()
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1|br)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert html_density.extract_text(table(spark, SMALL, "pages").filter("false")).count() == 0


def auc(y, score):
    ranks = pd.Series(score).rank().to_numpy()
    ones = int((y == 1).sum())
    return (ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_quality_scores(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    got = quality_gbt.quality_scores(docs, labels).toPandas()
    held = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert len(got) == docs.count() and auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    changed = labels.withColumn("quality", F.when(crc_mod(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_gbt.quality_scores(docs, changed).toPandas()
    assert dict(zip(got.doc_id, got.score, strict=True)) == dict(zip(again.doc_id, again.score, strict=True))


def test_classifiers_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 5), (2, None, None, 6), (None, "", "fr", 7), (1, "a b", "en", 8)], "doc_id bigint, text string, lang string, score int")
    labels = spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for score in (quality_gbt.quality_scores, toxicity_cnn.toxicity_scores):
        rows = score(docs, labels).collect()
        assert len(rows) == 4 and all(r.score == 0.5 for r in rows)
        assert score(docs.filter("false"), labels).count() == 0


def test_forest_arrays_follow_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality_gbt.FEATURES)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 5] > 0)).astype(float)
    forest = quality_gbt.fit(x, y, trees=20)
    for i in range(20):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            total += v[node - (2**forest.depth - 1)]
        assert forest.raw(x[i : i + 1])[0] == pytest.approx(total)
    assert auc(y, forest.score(x)) > 0.97


def test_toxic_words_are_found_in_long_texts():
    rng = np.random.default_rng(1)
    plain, bad = rng.integers(0, 1 << 63, 400).astype(np.uint64), rng.integers(0, 1 << 63, 3).astype(np.uint64)
    texts, y = [], []
    for i in range(500):
        words = rng.choice(plain, rng.integers(5, 200))
        if i % 4 == 0:
            words[rng.integers(len(words))] = rng.choice(bad)
        texts.append(words)
        y.append(i % 4 == 0)
    words = toxicity_cnn.padded(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    y = np.array(y, np.float32)
    model = toxicity_cnn.train(words, y)
    raw = toxicity_cnn.Scorer(model).raw(words)
    assert auc(y, raw) > 0.99
    # Slices don't matter, nor how long a text is.
    long = np.concatenate([rng.choice(plain, 150_000), bad[:1], rng.choice(plain, 50_000)])
    one = toxicity_cnn.padded(np.concatenate([long, texts[1]]), np.array([0, len(long), len(long) + len(texts[1])]))
    direct = toxicity_cnn.pooled(toxicity_cnn.convolve((model.one @ model.kernel)[one.one] + (model.two @ model.kernel)[one.two], model.bias), one.start, one.size)
    assert toxicity_cnn.Scorer(model).raw(one) == pytest.approx(np.maximum(direct, 0) @ model.out + model.shift, rel=1e-4)
    empty = toxicity_cnn.padded(np.zeros(0, np.uint64), np.array([0, 0, 0]))
    assert len(toxicity_cnn.Scorer(model).raw(empty)) == 2


@pytest.mark.parametrize("block,part", [(512, 4096), (48, 200)])
def test_neighbours_recall(spark, monkeypatch, block, part):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    monkeypatch.setattr(nn_descent, "PART", part)
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = nn_descent.nearest(vectors).toPandas()
    x = vectors.toPandas().sort_values("vec_id")
    ids, v = x.vec_id.to_numpy(), np.array(x.embedding.tolist(), dtype=float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = v @ v[i]
        order = np.lexsort((ids, -score))
        true = set(ids[order[ids[order] != ids[i]][:20]])
        mine = got[got.query_id == ids[i]].sort_values("rank")
        hits, total = hits + len(true & set(mine.vec_id)), total + 20
        assert mine["rank"].tolist() == list(range(1, 21)) and ids[i] not in set(mine.vec_id)
        assert np.allclose(mine.score, score[np.searchsorted(ids, mine.vec_id)], atol=1e-12)
    assert hits / total >= 0.9


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, [1.0, None]), (9, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, rank string")
    got = [tuple(r) for r in nn_descent.nearest(df).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (0, 4, 20, 0.0)]
    # Two rows of one id and vector: each is the other's nearest.
    assert got[4:] == sorted([(20, 1, 20, 1.0), (20, 2, 1, 0.5), (20, 3, 2, 0.5), (20, 4, 0, 0.0)] * 2)
    assert nn_descent.nearest(df.filter("false")).count() == 0


def test_neighbours_on_thin_partitions_and_equal_vectors(spark):
    """More partitions than vectors, adaptive execution off, doubles of all magnitudes, a vector that most rows share."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)) * 10.0 ** rng.integers(-60, 60, size=(40, 1))
    x[10:35] = x[10]
    df = spark.createDataFrame([(20 * i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(40)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = nn_descent.nearest(df).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for i in range(40):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(40), -score)) if j != i][:20]
        mine = got[got.query_id == 20 * i].sort_values("rank")
        assert mine.vec_id.tolist() == [20 * j for j in order] and np.allclose(mine.score, score[order], rtol=1e-12, atol=0)


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    scores = staged(toxicity_cnn.toxicity_scores(docs, labels), "t")
    assert scores.count() == docs.count()
    assert scores.filter((F.col("predicted") == 1) != (F.col("score") >= 0.3)).isEmpty() and scores.filter(F.col("flagged") != (F.col("score") >= F.col("lang_threshold"))).isEmpty()
    held = scores.filter("held_out").join(labels.select("doc_id", "toxic").dropna(), "doc_id").toPandas()
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) >= 0.9
    caught, named = held[held.toxic == 1].predicted.mean(), held[held.predicted == 1].toxic.mean()
    assert caught >= 0.7 and named >= 0.7
    by_lang = scores.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.countDistinct("lang_threshold").alias("n")).collect()
    assert all(r.n == 1 for r in by_lang)


def test_toxicity_looks_at_texts_alone(spark):
    """Held-out labels, ids, languages and sources change no score; equal texts score alike; whole long texts count."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    long = spark.createDataFrame([(10**9 + i, t, None, None, None) for i, t in enumerate(["", None, "word " * 300_000, "word " * 300_000])], docs.schema)
    more = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 10**6, "lang": F.lit("zz"), "source": F.lit(None).cast("string")})).unionByName(long)
    flipped = labels.withColumn("toxic", F.when(crc_mod(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r.doc_id: r.score for r in toxicity_cnn.toxicity_scores(more, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity_cnn.toxicity_scores(more, flipped).collect()}
    assert one == two and len(one) == more.count()
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert max(abs(one[i] - one[i + 10**6]) for i in ids) < 1e-6
    assert one[10**9] == one[10**9 + 1] and abs(one[10**9 + 2] - one[10**9 + 3]) < 1e-6


def test_hash_sample_is_bounded(spark):
    rows = spark.range(20_000)
    assert 800 <= hash_sample(rows, "id", 1000).count() <= 1000 and hash_sample(rows, "id", 20_000).count() == 20_000

"""Operators 11 to 13 against plain Python and the public tokenizers library."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import bpe_automaton, fill_in_middle, filter_audit, queries
from spanweave.llm.storage import tokenizer_path

DOCS = "doc_id long, text string, lang string, labels string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def _mixed_documents(seed=4):
    """Texts with many copies, nulls, empty and very long texts, repeated rows; the last two columns clash with the operators' own."""
    draw = random.Random(seed)
    pool = ["", "one two", "a" * 50_000, " \t\n", "Loud CAPITALS HERE " * 80, "costs $5 " * 120, "é ü 中 " * 150, "same line\n" * 90]
    pool += [" ".join(draw.choice(["w%d" % draw.randint(0, 400), "Word", "x#y", "zz"]) for _ in range(draw.randint(1, 300))) for _ in range(40)]
    rows = [(k, draw.choice(pool) if draw.random() < 0.5 else pool[9], draw.choice(["en", "de", None, ""]), "l", 7) for k in range(900)]
    rows += [(k, None, "fr", "l", 7) for k in range(900, 906)] + rows[:20] + [(None, pool[9], "en", "l", 7)] * 3 + [(5, "another text under five", "en", "l", 7)]
    return rows


def _audit(rows, labels):
    """The audit row by row, as the filters are worded."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    judged = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (i is not None and least[text] < i)
        judged.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [j for j in alive if f in j[1]]
                shares[f] += len(gone)
                redundant = sum(f in j[1] for j in own) - len(gone)
                alive = [j for j in alive if f not in j[1]]
                out[part, "".join(order), step] = [len(alive), len(gone), redundant, sum(j[1] == f for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_audit_equals_walk_through_all_orders(spark, parts):
    rows = _mixed_documents()
    labels = [(k, k % 3 % 2, int(k % 7 == 0)) for k in range(0, 900, 2)] + [(4, 0, 1), (None, 1, 1), (8, None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        # Many partitions cut the run of copies many times.
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = filter_audit.filter_audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r[:3]): list(r[3:]) for r in found} == _audit(rows, labels)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_colliding_fingerprints(spark, monkeypatch):
    """Texts under one fingerprint are told apart by their content, also at the borders of partitions."""
    from spanweave.llm import text_runs

    monkeypatch.setattr(text_runs.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    rows = [(k, "text %d" % (k % 3), "en", "l", 0) for k in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        masks = filter_audit.failure_masks(filter_audit.compared(spark.createDataFrame(rows, DOCS))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.doc_id for r in masks) == list(range(200)) and {r.doc_id for r in masks if not r.mask & filter_audit.E} == {0, 1, 2}


def test_audit_of_nothing(spark):
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None, "", 0)], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {(r.kept, r.removed, r.redundant) for r in one if r.filter_order[r.step - 1] == "A"} == {(0, 1, 0)}


def _cut(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing the text."""
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:one], text[one:two], text[two:]
    return (n, "spm", one, two - one, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", one, two - one, f"<P>{p}<S>{s}<M>{m}")


def test_middle_equals_slices(spark):
    rows = _mixed_documents() + [(2000 + k, t, "en", "", 0) for k, t in enumerate(["holds <P> already", "<M>", "<<S", "P>", "<", "\x00a\x00", "👍🏽" * 3000, "é" * 70_000] * 4)]
    found = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found), key=key) == sorted(((i, *_cut(i, t), t or "") for i, t, *_ in rows), key=key)
    digests = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, DOCS), digests=True).select(*fill_in_middle.digest_columns()).collect()
    assert {(r.doc_id, r.output_sha256) for r in digests} == {(r.doc_id, hashlib.sha256(r.output.encode()).hexdigest()) for r in found}
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("sizes", [[], [0], [3, 1, 4, 1, 2], [1] * 2000, [4] * 1500, [1, 4, 2, 3] * 900, [100_000, 1, 1, 70_000]])
def test_elias_fano_selects_every_value(sizes):
    values = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int64)
    held = fill_in_middle.EliasFano(values)
    assert [held.select(k) for k in range(len(held))] == values.tolist()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = bpe_automaton.read_vocabulary(f.read())
    return bpe_automaton.Codec(bpe_automaton.Automaton(vocabulary), vocabulary.added)


def test_automaton_equals_library(codec, library):
    draw = random.Random(8)
    signs = ["abcdefghij etaoin", "0123456789", "'stredmvl ", "\n\t \r\x0b\x1c\x85\xa0", "éñüß中文字テスト", "😀👍🏽", "-=_*#<|>"]
    texts = ["".join(draw.choice(draw.choice(signs)) for _ in range(draw.randint(0, 70))) for _ in range(4000)]
    texts += [f"a{chr(c)}1{chr(c)}-{chr(c)}\n" for c in range(1, 0x2600)] + ["a" * 30_000, "-" * 20_000, "中" * 9000, " " * 5000, "x<|endoftext|>y <|endoftext|><|endoftext", "\x00"]
    for text, theirs in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.ids, text
        assert codec.decode(ids) == library.decode(theirs.ids, skip_special_tokens=False) == text


def _merged(word, ranks):
    """Pairs merged one kind after the other, by priority, left to right."""
    parts = list(word)
    for a, b in ranks:
        k = 0
        while k + 1 < len(parts):
            if parts[k] == a and parts[k + 1] == b:
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


def test_automaton_of_random_merges():
    """Small alphabets with merges of equal parts, unreachable merges and merges of one token twice."""
    draw = random.Random(2)
    for _ in range(150):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(draw.randint(0, 12)):
            pair = draw.choice(tokens), draw.choice(tokens)
            if pair not in merges and "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        number = {t: k for k, t in enumerate(tokens)}
        vocabulary = bpe_automaton.Vocabulary({k: t.encode() for t, k in number.items()}, [(number[a], number[b], number[a + b]) for a, b in merges], {})
        encoder = bpe_automaton.Encoder(bpe_automaton.Automaton(vocabulary))
        for _ in range(60):
            word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 14)))
            assert [tokens[t] for t in encoder.tokens(word.encode())] == _merged(word, merges), (word, merges)


def test_words_are_kept_within_bounds(codec, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "CACHED_WORDS", 50)
    monkeypatch.setattr(bpe_automaton, "CACHED_ARCS", 40)
    words = bpe_automaton.Encoder(codec.words.automaton)
    again = bpe_automaton.Encoder(codec.words.automaton)
    for k in list(range(300)) * 2:
        assert words[f"word{k}"] == again[f"word{k}"]
        assert len(words) <= 50 and len(words.elder) <= 50 and len(words.arcs) <= 40


def test_vocabularies_that_would_encode_otherwise_are_refused():
    import json

    file = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"vocab": {"a": 0}, "merges": [], "ignore_merges": False}}
    assert bpe_automaton.read_vocabulary(json.dumps(file)).labels == {0: b"a"}
    for change in ({"normalizer": {"type": "NFC"}}, {"model": file["model"] | {"ignore_merges": True}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            bpe_automaton.read_vocabulary(json.dumps(file | change))


def test_automaton_in_spark(spark, library, codec):
    rows = _mixed_documents()[:200] + [(1, "<|endoftext|> and on", "en", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    shared = bpe_automaton.shared_automaton(spark, tokenizer_path("byte_bpe_50k.json"))
    found = bpe_automaton.bpe_digest(docs, shared).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows]
    expected = [(r[0], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, x in zip(rows, ids, strict=True)]
    assert sorted(map(tuple, found)) == sorted(expected)
    held = bpe_automaton.with_ids(docs.withColumn("ids", F.lit("clash")), shared)
    assert held.columns == ["doc_id", "lang", "labels", "mask", "ids"] and sorted((r.doc_id, r.ids) for r in held.collect()) == sorted((r[0], x) for r, x in zip(rows, ids, strict=True))
    assert sorted(map(tuple, bpe_automaton.decoded(held, shared).collect())) == sorted((r[0], r[1] or "") for r in rows)
    assert bpe_automaton.bpe_digest(spark.createDataFrame([], DOCS), shared).count() == 0
    assert bpe_automaton.decoded(spark.createDataFrame([(1, None), (2, [0, None, 999_999])], "doc_id long, ids array<int>"), shared).collect() == [(1, ""), (2, "!")]


def test_queries_of_all_operators_are_there():
    assert {int(n[2:].split("_")[0]) for n in queries.queries() if n[2].isdigit()} == set(range(1, 14))

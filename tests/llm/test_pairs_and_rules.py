"""The pair join, the rules, the mix and the tool calls against brute force."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spanweave.llm import mixing, ngram_join, quality_rules, tool_calls
from spanweave.llm.components import connected_components
from spanweave.llm.oracle import ORACLE

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept int, pos int"


def documents(spark, n=160, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 120))) for _ in range(n // 3)]
    rows = [None, "", "one", "One", "two words", "a b c d e", "A b C d e", "\n\n \t", "x" * 20_000, ("long " * 6000)]
    while len(rows) < n:
        words = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    return spark.createDataFrame([(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None]), None, "clash", 1, 2) for i, t in enumerate(rows)], DOCS)


def sets_of(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def brute_components(rows, percent=75):
    sets, parent = {r.doc_id: sets_of(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    docs = documents(spark, seed=seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(docs.collect())


def test_jaccard_edge_cases(spark):
    docs = documents(spark, 30)
    assert ngram_join.jaccard_components(docs.filter("false")).count() == 0
    twice = docs.union(docs).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = ngram_join.jaccard_components(twice).collect()
    assert len(rows) == 63
    expected = brute_components(docs.collect())
    assert all(r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == expected[r.doc_id] for r in rows)


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_jaccard_large_group_and_common_shingle(spark, monkeypatch, percent):
    """A large near-copy group on several rounds, a shingle in all documents, few names sent to all."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(ngram_join, "POSTING", 4)
    monkeypatch.setattr(ngram_join, "CENTRES", 1)
    monkeypatch.setattr(ngram_join, "BUNDLE", 8)
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 16)
    rng, licence = random.Random(percent), "all rights of this work are reserved by its authors"
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    texts += [licence + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40))) for _ in range(80)] + [licence] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, percent=percent).collect()}
    assert got == brute_components(docs.collect(), percent)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def against_sql(rows, sql, columns, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    key = lambda x: sorted(map(repr, x))
    assert key(tuple(r) for r in rows.select(*columns).collect()) == key(expected)


def test_rules_against_sql_and_brute_force(spark):
    docs = documents(spark, 120)
    got = quality_rules.quality_verdicts(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    against_sql(got, ORACLE["op8_quality_rules"], columns, documents=docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got.collect():
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", texts[r.doc_id]) if w]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(inside))
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_verdicts(docs.filter("false")).count() == 0


def test_sketches_merge(spark):
    counts = quality_rules.base_counts(documents(spark, 60))
    whole = quality_rules.merged(quality_rules.ratio_sketches(counts))
    parts = quality_rules.ratio_sketches(counts.filter("doc_id % 2 = 0")).union(quality_rules.ratio_sketches(counts.filter("doc_id % 2 = 1")))
    assert sorted(whole.collect()) == sorted(quality_rules.merged(parts).collect())
    assert spark.range(1).select(*[quality_rules.bucket(F.lit(x).cast("long")).alias(f"b{x}") for x in (0, 63, 127, 128, 129, 1000)]).first()[:] == (0, 63, 127, 128, 128, 1000)


def test_mix_against_sql(spark):
    docs = documents(spark, 120)
    against_sql(mixing.mix(docs), ORACLE["op9_source_mixing"], ["doc_id", "source", "pass", "block", "slot", "n_tokens"], documents=docs)
    assert mixing.mix(docs.filter("false")).count() == 0


def test_mix_limits_and_entropy(spark):
    sources = spark.createDataFrame([("big", 9000), ("mid", 900), ("small", 100), ("none", 0)], "source string, tokens bigint")
    a = mixing.exponent(sources, flatten=1.0, repeat_limit=2.0)
    shares = [0.9, 0.09, 0.01]
    weights = [p**a for p in shares]
    reads = [w / sum(weights) / p for w, p in zip(weights, shares, strict=True)]
    assert max(reads) <= 2.0 < max(w / p / sum(x ** (a - 2e-6) for x in shares) for w, p in zip([x ** (a - 2e-6) for x in shares], shares, strict=True))
    assert mixing.exponent(sources, flatten=0.0, repeat_limit=None) == 1.0 and mixing.exponent(sources, flatten=1.0, repeat_limit=None) == 0.0


def test_tool_calls_of_messages_against_sql(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if (c, t) == (3, 2) else f'say "{c}" \\ {t}\n' * (t * 20 + 1)) for c in range(6) for t in range(c + 1)] + [(9, 3, "assistant", "alone"), (9, 4, "user", "late"), (8, 0, "system", "x")]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = tool_calls.linked_calls(*tool_calls.calls_of_messages(talk), tool_calls.REPLY_TOOL)
    got = got.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("call_turn", "result_turn", "level")} | {"canonical_md5": F.md5(F.col("canonical").cast("binary"))})
    against_sql(got, ORACLE["op1_tool_call_linking"], ["conv_id", "call_id", "name", "call_turn", "result_turn", "level", "valid", "errors", "canonical_md5"], conversations=talk)


def test_tool_call_faults(spark):
    call = lambda i, name="add", args='{"x":1}', needs=(): f'{{"id":"{i}","name":"{name}","arguments":{args},"needs":[{",".join(chr(34) + n + chr(34) for n in needs)}]}}'
    rows = [
        (1, 0, "assistant", '{"tool_calls":[' + ",".join([call("a", args='{ "y": "q", "x": 2 }'), call("b", needs=("a",)), call("c", needs=("b", "a", "zz")), call("d", needs=("e",)), call("e", needs=("d",)), call("f", name="no"), call("g", args='{"x":"1","z":0}'), call("h", args="{}")]) + "]}"),
        (1, 1, "tool", '{"tool_call_id":"a","content":"3"}'), (1, 2, "tool", '{"tool_call_id":"q","content":"3"}'), (1, 3, "assistant", '{"tool_calls":[' + call("a") + "]}"), (1, 4, "user", "not json"), (1, 5, "user", None),
    ]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    tools = {"add": {"properties": {"x": {"type": "number"}, "y": {"type": "string"}}, "required": ["x"], "additionalProperties": False}}
    got = {(r.call_id, r.call_turn): r for r in tool_calls.linked_calls(*tool_calls.calls_of_json(talk), tools).collect()}
    a = got["a", 0]
    assert (a.valid, a.level, a.result_turn, a.canonical) == (True, 0, 1, '{"arguments":{"x":2,"y":"q"},"id":"a","name":"add","needs":[],"result":"3"}')
    assert [got[k, 0].level for k in "bcde"] == [1, 2, None, None]
    assert got["a", 3].errors == "repeated id" and got["c", 0].errors == "unknown need; no result" and got["d", 0].errors == "circular; no result"
    assert got["f", 0].errors.startswith("unknown tool") and got["g", 0].errors.startswith("x is not number; unknown z") and got["h", 0].errors.startswith("missing x")
    assert got["q", None].errors == "no call" and len(got) == 10
    assert tool_calls.linked_calls(*tool_calls.calls_of_json(talk.filter("false")), tools).count() == 0


def test_nested_schemas(spark):
    tools = {"t": {
        "properties": {
            "unit": {"type": "string", "enum": ["C", "F"]}, "at": {"type": "object", "properties": {"lat": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["lat"], "additionalProperties": False},
            "legs": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer", "enum": [1, 2]}}, "required": ["n"], "additionalProperties": True}},
        }, "required": ["at"], "additionalProperties": False,
    }}
    cases = {
        '{"at":{"lat":1.5,"tags":["a"]},"unit":"C","legs":[{"n":1,"more":0}]}': [], '{"at":{}}': ["missing at.lat"], '{"at":{"lat":"x","tags":["a",1]},"unit":"K"}': ["at.lat is not number", "at.tags[1] is not string", "unit is none of its values"],
        '{"at":{"lat":1,"z":2},"legs":[{},{"n":3},5]}': ["unknown at.z", "missing legs[0].n", "legs[1].n is none of its values", "legs[2] is not object"], "{}": ["missing at"], "[]": ["malformed arguments"], '{"at":null,"q":1}': ["at is not object", "unknown q"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = dict(df.select("a", tool_calls.argument_errors(F.lit("t"), F.col("a"), tools)).collect())
    assert got == cases


def test_no_call_or_result_is_lost(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "add", '{"x":2}', []), (1, 0, "a", "add", '{"x":1}', []), (1, 0, "b", "add", '{"x":1}', ["a"]), (1, 0, "b", "add", '{"x":1}', ["a"]), (None, 0, "a", "add", '{"x":1}', []), (1, 0, None, "add", None, None), (2, None, "a", "add", "{}", [None])],
        "conv_id bigint, turn bigint, call_id string, name string, arguments string, needs array<string>",
    ).withColumns({"level": F.lit("clash"), "first": F.lit(7), "call_turn": F.lit("clash")})
    results = spark.createDataFrame(
        [(1, 1, "a", "one"), (1, 2, "a", "two"), (1, 2, "a", "two"), (1, 0, "a", "early"), (1, 3, "b", None), (1, 3, "b", ""), (None, 1, "a", "x"), (1, 1, None, "y"), (2, 1, "a", "z")],
        "conv_id bigint, turn bigint, call_id string, content string",
    ).withColumn("late", F.lit("clash"))
    rows = tool_calls.linked_calls(calls, results, {"add": {"properties": {"x": {"type": "integer"}}, "required": ["x"]}}).collect()
    asked = [r for r in rows if r.call_turn is not None or r.name is not None]
    assert len(asked) == 7
    a = [(r.valid, r.errors, r.result_turn) for r in asked if (r.conv_id, r.call_id) == (1, "a")]
    assert sorted(a, key=repr) == [(False, "repeated id", None), (True, "", 1)]
    assert next(r.canonical for r in asked if r.valid and r.call_id == "a").startswith('{"arguments":{"x":1}')
    assert sorted(r.errors for r in asked if r.call_id == "b") == ["", "repeated id"]
    assert sorted(r.errors for r in asked if r.conv_id is None or r.call_id is None) == ["malformed arguments; no id", "no id"]
    assert sorted((r.conv_id or 0, r.call_id or "", r.result_turn, r.errors) for r in rows if r.name is None) == sorted(
        [(1, "a", 2, "repeated result"), (1, "a", 2, "repeated result"), (1, "a", 0, "no call"), (1, "b", 3, "repeated result"), (0, "a", 1, "no call"), (1, "", 1, "no call"), (2, "a", 1, "no call")]
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_of_long_chains_branches_and_circles(spark, seed):
    rng = random.Random(seed)
    needs = {f"a{i}": [f"a{i - 1}"] if i else [] for i in range(40)} | {f"b{i}": [] for i in range(3)}
    for i in range(30):
        needs[f"c{i}"] = rng.sample(sorted(needs), rng.choice([1, 1, 2, 4]))
    needs |= {"x": ["y"], "y": ["z"], "z": ["x"], "over": ["x", "a5"], "p": ["q", "r"], "q": ["p", "r"], "r": ["p", "q"], "self": ["self"], "after": ["over", "p"], "m": ["n", "a3"], "n": ["m", "a4"]}

    def level(c, below=()):
        found = [None if n in (*below, c) else level(n, (*below, c)) for n in needs[c]]
        return None if None in found else max(found, default=-1) + 1

    expected = {c: level(c) for c in needs if level(c) is not None}
    calls = spark.createDataFrame([(1, c) for c in needs], "conv_id bigint, call_id string")
    open_needs = spark.createDataFrame([(1, c, n) for c, ns in needs.items() for n in ns], "conv_id bigint, call_id string, need string")
    got = tool_calls.levels(calls, open_needs).collect()
    assert len(got) == len(expected) and {r.call_id: r.level for r in got} == expected

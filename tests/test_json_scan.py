"""JSON edits, rows and SQL functions over random documents, against the standard library's database."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from spanweave.functions import json_docs as j
from spanweave.functions.json_scan import DEEPEST, Document, Malformed, merged, path_steps

DB = sqlite3.connect(":memory:")


def value(draw, depth=0):
    kind = draw.randrange(10 if depth < 4 else 6)
    if kind < 6:
        return draw.choice(["null", "true", "false", "0", "-17", "2.50", "1e3", '""', '"x"', r'"a\nb"', r'"\u00fc"', r'"q\"q"', "123456789012"])
    inner = [value(draw, depth + 1) for _ in range(draw.randint(0, 4))]
    space = lambda: draw.choice(["", "", " ", "\n\t "])
    if kind < 8:
        return "[" + ",".join(space() + x + space() for x in inner) + "]"
    return "{" + ",".join(f"{space()}{json.dumps(draw.choice(['a', 'b', 'c', 'x y', 'k.l']))}{space()}:{x}" for x in inner) + space() + "}"


def path(draw):
    return "$" + "".join(draw.choice([".a", ".b", ".c", '."x y"', "[0]", "[1]", "[2]", "[#-1]", "[#-2]", "[#]"]) for _ in range(draw.randint(0, 3)))


def ask(text, *values):
    return DB.execute(f"SELECT {text}", values).fetchone()[0]


def test_edits_of_random_documents():
    draw = random.Random(1)
    for _ in range(4000):
        doc, where, put = value(draw), path(draw), value(draw)
        for name, create, replace in (("json_set", True, True), ("json_insert", True, False), ("json_replace", False, True)):
            document = Document(doc)
            if where != "$":
                document.put(path_steps(where), str(Document(put)), create, replace)
                assert str(document) == ask(f"{name}(?,?,json(?))", doc, where, put), (name, doc, where, put)
            # A further edit goes on from what stands, and doesn't enter what was put.
            document.put(path_steps("$.a"), "7", create, replace)
            document.put(path_steps("$.c.d"), "8", create, replace)
            first = "" if where == "$" else f"?{where!r},json(?),".replace("?", "", 1)
            assert str(document) == ask(f"{name}(?,{first}'$.a',7,'$.c.d',8)", doc, *([] if where == "$" else [put])), (name, doc, where, put)
            Document(str(document))
        if where != "$":
            document = Document(doc)
            document.remove(path_steps(where))
            assert str(document) == ask("json_remove(?,?)", doc, where), (doc, where)


def test_patches_of_random_documents():
    draw = random.Random(2)
    for _ in range(3000):
        doc, patch = value(draw), value(draw)
        keys = lambda text: json.loads(text, object_pairs_hook=lambda p: len({k for k, _ in p}) == len(p) and dict(p) or (p and [][0]) or {})
        try:
            keys(doc), keys(patch)
        except IndexError:
            continue  # repeated keys
        assert json.loads(merged(doc, patch)) == json.loads(ask("json_patch(?,?)", doc, patch)), (doc, patch)


def test_rows_of_random_documents():
    """Keys, values, types, ids, parents and paths, of the whole and of what lies at keys."""
    draw = random.Random(3)
    for _ in range(2500):
        doc, root = value(draw), "$" + "".join(draw.choice([".a", ".b"]) for _ in range(draw.choice([0, 0, 1, 2])))
        for deep in (False, True):
            theirs = DB.execute(f"SELECT key, json_type(?, fullkey) IS NOT NULL, type, id, parent, fullkey, path FROM json_{'tree' if deep else 'each'}(?,?)", (doc, doc, root)).fetchall()
            ours = list(Document(doc).rows(root, deep))
            assert [(r[2], r[4], r[5], r[6]) for r in ours] == [(t, i, parent, full) for _, _, t, i, parent, full, _ in theirs], (doc, root, deep)
            assert [None if k is None else str(k) for k, *_ in theirs] == [r[0] for r in ours], (doc, root, deep)
            assert [r[7] for r in ours] == [t[6] for t in theirs], (doc, root, deep)


def test_what_is_malformed():
    draw = random.Random(4)
    for _ in range(6000):
        text = value(draw)
        at = draw.randint(0, len(text))
        text = text[:at] + draw.choice(["", ",", "]", "}", '"', "0", "-", ".", "e", ":", chr(11), chr(160), chr(92), "nul", "tru"]) + text[at + draw.randint(0, 1) :]
        try:
            Document(text)
            ours = 1
        except Malformed:
            ours = 0
        # The standard library's release also takes a few escapes and white space that JSON doesn't have.
        if ours != ask("json_valid(?)", text):
            with pytest.raises(ValueError):
                json.loads(text)
            assert not ours, text


@pytest.mark.parametrize("depth", [1500, DEEPEST])
def test_deep_documents(depth):
    for opening, inner, closing in (("[", "1", "]"), ('{"a":', "1", "}"), ('[{"a":', "[ ]", "}]")):
        levels = depth // (opening.count("[") + opening.count("{")) - (inner == "[ ]")
        text = opening * levels + inner + closing * levels
        document = Document(text)
        assert str(document) == text.replace(" ", "")
        step = [s for s in ([0] if opening[0] == "[" else []) + (["a"] if "a" in opening else [])]
        document.put(step * levels, "[2]", True, True)
        assert str(document) == text.replace(inner + closing, "[2]" + closing, 1)
        assert len(list(Document(text).rows("$", True))) == text.count("[") + text.count("{") + (inner == "1")
        assert merged(text, '{"z":1}').endswith('"z":1}')
    with pytest.raises(Malformed):
        Document("[" * (DEEPEST + 1) + "]" * (DEEPEST + 1))


def test_deep_documents_in_spark(spark):
    texts = ['{"a":' * DEEPEST + "1" + "}" * DEEPEST, "[" * 1200 + "]" * 1200, None, "5"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    rows = {r.k: r for r in df.select("k", j.json_minify("s").alias("m"), j.json_remove("s", "$.a").alias("r"), j.json_set("s", "$.b.c[0]", F.lit("x"), "$.b.c[#]", F.lit(2)).alias("p")).collect()}
    assert [rows[k].m for k in range(4)] == texts and rows[0].r == "{}" and rows[0].p == texts[0][:-1] + ',"b":{"c":["x",2]}}'
    with pytest.raises(Exception, match="malformed JSON"):
        spark.createDataFrame([("[" * 2001 + "]" * 2001,)], "s string").select(j.json_minify("s")).collect()


def test_functions_in_sql(spark):
    """Any number of arguments, paths and values that come from columns."""
    session = spark.newSession()
    j.register_json(session)
    draw = random.Random(5)
    rows = [(k, value(draw), path(draw), path(draw), draw.choice(["v", None, "it's"]), draw.randint(0, 9)) for k in range(400)] + [(400, None, "$", "$", "v", 1), (401, "[1]", None, "$", "v", 1)]
    session.createDataFrame(rows, "k int, s string, p string, q string, t string, n int").createOrReplaceTempView("docs")
    calls = [
        "json_extract(s, p)", "json_extract(s, p, q)", "json_type(s)", "json_type(s, p)", "json_array_length(s)", "json_array_length(s, p)", "json_valid(s)", "json_quote(t)", "json_quote(n)", "json_array(t, n, NULL)", "json_array()", "json_object('a', t, 'b', n)",
        "json_set(s, p, t)", "json_set(s, p, n, q, t)", "json_insert(s, p, n)", "json_replace(s, p, t, q, n)", "json_remove(s, p)", "json_remove(s, p, q)", "json_remove(s)",
    ]
    spark_calls = ["json_array(CAST(NULL AS INT))" if c == "json_array()" else c for c in calls]
    found = {r.k: list(r)[1:] for r in session.sql(f"SELECT k, {', '.join(f'{c} AS c{i}' for i, c in enumerate(spark_calls))} FROM docs").collect()}
    DB.execute("CREATE TEMP TABLE docs (k, s, p, q, t, n)")
    DB.executemany("INSERT INTO docs VALUES (?,?,?,?,?,?)", rows)
    for i, call in enumerate(calls):
        text = "json_array(NULL)" if call == "json_array()" else call
        for k, expected in DB.execute(f"SELECT k, {text} FROM docs"):
            got = found[k][i]
            if isinstance(expected, float):
                assert float(got) == expected, (call, rows[k])
            elif k == 401 and call.startswith(("json_set", "json_insert", "json_replace", "json_remove")):
                continue  # a null path: null here
            else:
                assert (None if got is None else str(got)) == (None if expected is None else str(expected)), (call, rows[k])
    each = session.sql("SELECT k, e.key, e.type, e.id, e.parent, e.fullkey FROM docs, LATERAL json_each(s, '$') e").collect()
    assert sorted(map(repr, map(tuple, each))) == sorted(repr((k, None if key is None else str(key), *rest)) for k, key, *rest in DB.execute("SELECT k, e.key, e.type, e.id, e.parent, e.fullkey FROM docs, json_each(s) e"))
    tree = session.sql("SELECT k, t.id, t.parent, t.fullkey FROM docs, LATERAL json_tree(s) t").collect()
    assert sorted(map(repr, map(tuple, tree))) == sorted(repr(x) for x in DB.execute("SELECT k, t.id, t.parent, t.fullkey FROM docs, json_tree(s) t"))

"""Faults that were found in earlier rounds: schemas of any kind, ids that texts share, very long labelled texts, closed drawings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanweave.llm import html_density, ngram_join, tool_calls, toxicity_cnn


def _wrong(value, schema, label=None):
    """What a JSON schema finds wrong, in plain Python."""
    name = label or "arguments"
    if isinstance(schema, bool):
        return [] if schema else [f"{name} is not allowed"]
    kinds = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}
    kind = kinds[type(value)]
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted
    fits = lambda w: kind == w or (w == "number" and kind == "integer") or (w == "integer" and kind == "number" and value == int(value))
    if wanted is not None and not any(map(fits, wanted)):
        return [f"{name} is not {' or '.join(wanted)}"]
    found, inner = [], lambda p: p if label is None else f"{label}.{p}"
    text = lambda x: json.dumps(int(x) if isinstance(x, float) and x == int(x) else x, sort_keys=True, separators=(",", ":"))
    if "enum" in schema and text(value) not in map(text, schema["enum"]):
        found.append(f"{name} is none of its values")
    if "const" in schema and text(value) != text(schema["const"]):
        found.append(f"{name} is not its value")
    own = schema.get("properties", {})
    for p in sorted(set(own) | set(schema.get("required", ()))):
        if kind == "object" and p in value:
            found += _wrong(value[p], own.get(p, True), inner(p))
        elif kind == "object" and p in schema.get("required", ()):
            found.append(f"missing {inner(p)}")
    others = schema.get("additionalProperties", True)
    if kind == "object":
        for p in sorted(set(value) - set(own)):
            found += [] if others is True else [f"unknown {inner(p)}"] if others is False else _wrong(value[p], others, inner(p))
    if kind == "array" and "items" in schema:
        for k, x in enumerate(value):
            found += _wrong(x, schema["items"], f"{name}[{k}]")
    for measure, least, most in ((value if kind in ("integer", "number") else None, "minimum", "maximum"), (len(value) if kind == "string" else None, "minLength", "maxLength"), (len(value) if kind == "array" else None, "minItems", "maxItems")):
        if measure is not None and measure < schema.get(least, measure):
            found.append(f"{name} is under its {least}")
        if measure is not None and measure > schema.get(most, measure):
            found.append(f"{name} is over its {most}")
    return found


SCHEMAS = [
    {"required": ["a", "b"], "properties": {"a": {"type": "integer"}}}, {"required": ["a"]}, {}, {"properties": {"a": {"type": ["string", "null"]}}}, {"properties": {"a": {"type": "null"}, "b": False}},
    {"properties": {"a": {"type": "integer"}}, "additionalProperties": False}, {"additionalProperties": {"type": "number", "minimum": 2}}, {"properties": {"a": {"items": {"type": ["integer", "boolean"]}, "maxItems": 2}}},
    {"properties": {"a": {"const": {"k": 1}}, "b": {"enum": [1, "x", None]}}}, {"properties": {"a": {"minimum": 1, "maximum": 5, "minLength": 2, "maxLength": 3}}, "title": "remark"},
    {"properties": {"it's": {"type": "string"}, "a": {"properties": {"b": {"required": ["c"]}}}}},
]


def test_schemas_against_plain_python(spark):
    draw = random.Random(3)

    def value(depth=0):
        kind = draw.randrange(9 if depth < 3 else 6)
        if kind == 6:
            return [value(depth + 1) for _ in range(draw.randint(0, 3))]
        if kind == 7:
            return {k: value(depth + 1) for k in draw.sample("abc", draw.randint(0, 3))}
        return [None, True, draw.randint(-3, 9), draw.choice([1.0, 2.5, -1.0]), draw.choice(["", "x", "yes", "many"]), 10**20 + 1, None, None, {"k": 1}][kind]

    cases = [{k: value() for k in draw.sample(["a", "b", "c", "it's"], draw.randint(0, 4))} for _ in range(250)]
    rows = [(k, json.dumps(c)) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, arguments string")
    found = {r.k: r for r in df.select("k", *[tool_calls.argument_errors(F.lit("t"), F.col("arguments"), {"t": s}).alias(f"s{i}") for i, s in enumerate(SCHEMAS)]).collect()}
    for k, case in enumerate(cases):
        for i, schema in enumerate(SCHEMAS):
            assert found[k][f"s{i}"] == _wrong(case, schema), (case, schema)


def test_schemas_with_unknown_keywords_are_refused():
    for schema in ({"pattern": "x"}, {"properties": {"a": {"oneOf": []}}}, {"items": {"type": "whole"}}, {"additionalProperties": {"not": {}}}):
        with pytest.raises(ValueError):
            tool_calls.check_schema(schema)


@pytest.mark.parametrize("swapped", [False, True])
def test_one_id_with_two_texts_loses_no_link(spark, swapped):
    words = [f"w{k}" for k in range(60)]
    x, near, y = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{k}" for k in range(50))
    first = [(5, x), (5, y)] if swapped else [(5, y), (5, x)]
    rows = spark.createDataFrame([*first, (9, near), (12, "far away from all of these texts")], "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_components(rows).collect()}
    assert {k: v for k, v in found.items() if k[0] == 9} == {(9, 56): 5} and found[12, 3] == 12


def test_one_giant_labelled_text_changes_no_other_score(spark):
    draw = random.Random(1)
    bad, good = ["awful", "vile", "hate", "scum"], ["garden", "river", "stone", "cloud"]
    rows = [(k, " ".join(draw.choice(bad if k % 4 == 0 else good) if draw.random() < 0.4 else f"n{draw.randint(0, 50)}" for _ in range(30)), "en") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    giant = [(k, (t + " ") * 40_000 if k == 4 else t, lang) for k, t, lang in rows]
    scores = {r.doc_id: r for r in toxicity_cnn.toxicity_scores(spark.createDataFrame(giant, "doc_id long, text string, lang string"), labels).collect()}
    held = [r for r in scores.values() if r.held_out]
    assert max(len(t) for _, t, _ in giant) > toxicity_cnn.MAX_TEXT_BYTES
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.9 * len(held)
    assert len(scores) == 400 and 0 <= scores[4].score <= 1


@pytest.mark.parametrize("icon", ["<svg/>", "<svg class='i' />", '<svg data-x="a>b"/>', "<svg><path d='M0'/></svg>", "<svg class=x><title>t</title></svg>", "<math/>", "<iframe src='x'></iframe>"])
def test_icons_in_a_paragraph_drop_nothing_behind_them(icon):
    page = f"<html><body><article><p>The first paragraph of this article.</p>{icon}<p>And after it {icon} comes more.</p></article></body></html>"
    assert html_density.main_text(page) == "The first paragraph of this article.\nAnd after it comes more."


@pytest.mark.parametrize("name", ["commentlist", "user-comments", "usercomments", "commentBox", "disqus_thread"])
def test_boxes_of_readers_go_also_where_words_run_together(name):
    page = f"<body><article><h1>Head</h1><p>The text of the article stands here.</p></article><ol class='{name}'><li>I do not agree at all with this text.</li></ol></body>"
    assert html_density.main_text(page) == "Head\nThe text of the article stands here."
    kept = "<body><article><h1>Head</h1><div class='commentary'><p>The commentary of the day stands here.</p></div></article></body>"
    assert html_density.main_text(kept) == "Head\nThe commentary of the day stands here."

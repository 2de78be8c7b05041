"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join on (conversation, identifier).  Calls
are ordered topologically by the calls they need, in rounds of joins that
halve the open chains: `level` is the length of the longest chain below a
call, and (level, call_turn, call_id) orders a
conversation so that no call comes before one that it needs.  Arguments are
checked against the tool's JSON schema (types, required and further properties, items, enums, bounds;
a schema with another keyword is refused),
and each exchange is written as canonical JSON: no white space, keys in order.  SQL functions only.

Rounds grow with the logarithm of the longest chain, and with the depth of
calls that need several open ones; a round joins only the calls that are
still open.  Identifiers are grouped by partial aggregates,
never gathered, so one identifier or conversation may hold any share of rows.

Edge cases: calls and results with a null conversation or identifier link
with nothing; of repeated calls with one identifier the first turn counts (of
several at that turn the smaller argument text, then name) and the others carry
the error "repeated id"; of calls equal in all columns one counts, whichever;
a call takes the earliest result at a later turn, of several at that turn the
smaller text; further results are rows of their own with a null call_turn and
the error "repeated result", and results without such a call with the error
"no call"; needs that name no call of the
conversation are ignored but reported; calls that need each other in a circle
have a null level and the error "circular"; other columns are not read; empty
tables give an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

#: The parameters of the tools of the conversations table, as JSON schemas.
REPLY_TOOL = {"reply": {"additionalProperties": False, "properties": {"n_chars": {"type": "integer"}, "style": {"type": "string"}, "text": {"type": "string"}}, "required": ["n_chars", "text"]}}


def calls_of_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain messages: a user's turn calls `reply`, the assistant's next turn is its result.

    calls: (conv_id, turn, call_id, name, arguments, needs); results:
    (conv_id, turn, call_id, content).  A call needs the user's turn before it.
    """
    ident = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    asked = messages.filter("role = 'user'")
    style = F.when(F.length("text") > 200, "long")
    arguments = F.to_json(F.struct("text", F.length("text").alias("n_chars"), style.alias("style")))
    needs = F.when(F.col("turn") >= 2, F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = asked.select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    results = messages.filter("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def calls_of_json(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages that carry them as JSON.

    A text ``{"tool_calls": [{"id", "name", "arguments": {...}, "needs": [...]}]}`` holds
    calls, one ``{"tool_call_id", "content"}`` a result; other texts hold neither.
    """
    call = "struct<id: string, name: string, arguments: string, needs: array<string>>"
    parsed = messages.select("conv_id", "turn", F.from_json("text", f"tool_calls array<{call}>, tool_call_id string, content string").alias("m"))
    calls = parsed.select("conv_id", "turn", F.explode("m.tool_calls").alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.needs", F.array().cast("array<string>")).alias("needs"))
    results = parsed.filter("m.tool_call_id is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    return calls, results


def _kind(value: Column) -> Column:
    """JSON type name of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer").when(name == "STRING", "string")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("number")
    )


def _none() -> Column:
    return F.array().cast("array<string>")


def _some(fault: Column) -> Column:
    """An array of the fault, or of nothing where it is null."""
    return F.when(fault.isNull(), _none()).otherwise(F.array(fault))


#: The keywords that are checked, and those that say nothing about what is valid (fixed names of JSON schemas).
CHECKED = frozenset(("type", "enum", "const", "properties", "required", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems"))
REMARKS = frozenset(("title", "description", "default", "examples", "$comment", "$schema", "$id", "deprecated", "readOnly", "writeOnly", "format"))
TYPES = frozenset(("null", "boolean", "integer", "number", "string", "array", "object"))


def check_schema(schema: dict | bool, at: str = "schema") -> None:
    """An error for a schema with a keyword that isn't checked here, so that none is passed over in silence."""
    if isinstance(schema, bool):
        return
    if odd := sorted(set(schema) - CHECKED - REMARKS):
        raise ValueError(f"{at}: {', '.join(odd)} not supported")
    if odd := sorted(set(_types(schema) or ()) - TYPES):
        raise ValueError(f"{at}: no such type: {', '.join(odd)}")
    for p, own in schema.get("properties", {}).items():
        check_schema(own, f"{at}.{p}")
    for k in ("items", "additionalProperties"):
        check_schema(schema.get(k, True), f"{at}.{k}")


def _types(schema: dict) -> list[str] | None:
    wanted = schema.get("type")
    return [wanted] if isinstance(wanted, str) else wanted


def _is(value: Column, kind: Column, wanted: str) -> Column:
    """Whether a variant is of a JSON schema's type: a number without a fraction is an integer however it is written."""
    if wanted == "number":
        return kind.isin("integer", "number")
    if wanted == "integer":
        number = F.try_variant_get(value, "$", "double")
        return (kind == "integer") | ((kind == "number") & F.coalesce(number % 1 == 0, F.lit(False)))
    return kind == wanted


def _faults(value: Column, schema: dict | bool, label: Column | None) -> Column:
    """What is wrong with a variant that is there (it may be JSON's null), an array of texts.

    As in the standard, `required` holds of objects alone and for any name,
    other properties are allowed unless additionalProperties forbids or
    describes them, and each keyword is silent on values of other types.
    """
    name = label if label is not None else F.lit("arguments")
    if schema is True:
        return _none()
    if schema is False:
        return F.array(F.concat(name, F.lit(" is not allowed")))
    kind, wanted = _kind(value), _types(schema)
    checks = []
    text = lambda e: json.dumps(e, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    inner = lambda p: p if label is None else F.concat(label, F.lit("."), p)
    for keyword, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if allowed is not None:
            written = F.coalesce(F.to_json(value), F.lit("null"))
            checks.append(_some(F.when(~written.isin([text(e) for e in allowed]), F.concat(name, F.lit(" is none of its values" if keyword == "enum" else " is not its value")))))
    for p in sorted(set(schema.get("properties", {})) | set(schema.get("required", ()))):
        at = F.try_variant_get(value, _member(p), "variant")
        missing = _some(F.when(kind == "object", F.concat(F.lit("missing "), inner(F.lit(p))))) if p in schema.get("required", ()) else _none()
        checks.append(F.when(at.isNull(), missing).otherwise(_faults(at, schema.get("properties", {}).get(p, True), inner(F.lit(p)))))
    others = schema.get("additionalProperties", True)
    if others is not True:
        held = F.coalesce(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
        own = F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>")
        more = F.array_sort(F.filter(F.transform(held, lambda e: e["key"]), lambda k: ~F.array_contains(own, k)))
        if others is False:
            checks.append(F.transform(more, lambda k: F.concat(F.lit("unknown "), inner(k))))
        else:
            left = F.filter(held, lambda e: ~F.array_contains(own, e["key"]))
            checks.append(F.flatten(F.transform(left, lambda e: _faults(e["value"], others, inner(e["key"])))))
    if "items" in schema:
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        each = F.transform(items, lambda v, i: _faults(v, schema["items"], F.concat(name, F.lit("["), i.cast("string"), F.lit("]"))))
        checks.append(F.flatten(each))
    number = F.when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double"))
    length = F.when(kind == "string", F.length(F.try_variant_get(value, "$", "string")))
    count = F.when(kind == "array", F.size(F.try_variant_get(value, "$", "array<variant>")))
    for measure, least, most in ((number, "minimum", "maximum"), (length, "minLength", "maxLength"), (count, "minItems", "maxItems")):
        if least in schema:
            checks.append(_some(F.when(measure < schema[least], F.concat(name, F.lit(f" is under its {least}")))))
        if most in schema:
            checks.append(_some(F.when(measure > schema[most], F.concat(name, F.lit(f" is over its {most}")))))
    found = F.concat(*checks) if checks else _none()
    if wanted is None:
        return found
    accepted = F.lit(False)
    for one in wanted:
        accepted = accepted | _is(value, kind, one)
    return F.when(~accepted, F.array(F.concat(name, F.lit(f" is not {' or '.join(wanted)}")))).otherwise(found)


def _member(p: str) -> str:
    """The path of a property; a name with both kinds of quotes can't be written in one."""
    quote = next((q for q in "'\"" if q not in p), None)
    if quote is None:
        raise ValueError(f"property name with both kinds of quotes: {p}")
    return f"$[{quote}{p}{quote}]"


def argument_errors(name: Column, arguments: Column, tools: dict[str, dict]) -> Column:
    """What is wrong with a JSON text of arguments, by the JSON schema of the tool of that name."""
    for tool, schema in tools.items():
        check_schema(schema, tool)
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    found = F.array(F.lit("unknown tool"))
    for tool, schema in tools.items():
        found = F.when(name == tool, _faults(value, schema, None)).otherwise(found)
    return F.when(value.isNull() | ~is_object, F.array(F.lit("malformed arguments"))).otherwise(found)


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call that no circle holds up; needs: (conv_id, call_id, need), all resolvable.

    The level of an open call is the largest of its ways: `weight` where need
    is null, else the level of `need` and `weight` more.  In a round each way
    to a call with at most one open need goes on to where that call leads, so
    chains halve; a way as long as there are calls lies on a circle.
    """
    key = ["conv_id", "call_id"]
    longest = calls.count()
    done = staged(calls.join(needs, key, "left_anti").select(*key, F.lit(0).alias("level")), "chat-levels")
    ways = needs.select(*key, "need", F.lit(1).alias("weight"))
    while True:
        leads = ways.groupBy(*key).agg(
            F.count("need").alias("open"), F.max(F.when(F.col("need").isNull(), F.col("weight"))).alias("base"),
            F.max("need").alias("next"), F.max(F.when(F.col("need").isNotNull(), F.col("weight"))).alias("more"),
        ).filter((F.col("open") == 1) & (F.col("more") < longest))
        leads = leads.select("conv_id", F.col("call_id").alias("need"), "base", "next", "more")
        leads = leads.unionByName(done.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("base")), allowMissingColumns=True)
        met = ways.join(leads.withColumn("met", F.lit(True)), ["conv_id", "need"], "left").withColumn("met", F.col("met").isNotNull() & (F.col("weight") < longest))
        way = lambda need, weight, met: F.struct(need.alias("need"), weight.alias("weight"), F.lit(met).alias("met"))
        none = F.lit(None).cast("string")
        further = F.array(F.when(F.col("base").isNotNull(), way(none, F.col("base") + F.col("weight"), True)), F.when(F.col("next").isNotNull(), way(F.col("next"), F.col("more") + F.col("weight"), True)))
        same = F.array(way(F.col("need"), F.col("weight"), False))
        gone = met.select(*key, F.explode(F.filter(F.when(F.col("met"), further).otherwise(same), lambda x: x.isNotNull())).alias("w")).select(*key, "w.*")
        gone = staged(gone.groupBy(*key, "need").agg(F.max("weight").alias("weight"), F.max("met").alias("met")), "chat-ways")
        if gone.filter("met").isEmpty():
            return done
        over = gone.groupBy(*key).agg(F.count("need").alias("open"), F.max("weight").alias("level")).filter("open = 0").select(*key, "level")
        over = staged(over, "chat-levels")
        done, ways = done.union(over), gone.join(over, key, "left_anti").drop("met")


def _ranked(rows: DataFrame, names: list[str], cell: Column, label: str) -> DataFrame:
    """Staged `rows` with `cell`, and `first`: whether it is the row of the smallest cell for its names, one of equal rows.

    Rows that share their names and cell are told apart by a number drawn when
    they are staged; a least cell per name is a partial aggregate, so no name
    is gathered.
    """
    drawn = staged(rows.withColumn("_cell", cell).withColumn("_draw", F.monotonically_increasing_id()), label)
    least = drawn.filter(" and ".join(f"{n} is not null" for n in names)).groupBy(*names).agg(F.min(F.struct("_cell", "_draw")).alias("_least"))
    marked = drawn.join(least, names, "left")
    return marked.withColumn("first", F.coalesce(F.struct("_cell", "_draw") == F.col("_least"), F.lit(False))).drop("_least", "_draw")


def linked_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Rows (conv_id, call_id, name, call_turn, result_turn, level, valid, errors, canonical)."""
    key = ["conv_id", "call_id"]
    cells = F.struct("turn", F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("name", F.lit("")).alias("name"), F.array_sort("needs").alias("needs"))
    calls = staged(_ranked(calls.select(*key, "turn", "name", "arguments", "needs"), key, cells, "chat-calls"), "chat-calls")
    heads = staged(calls.filter("first").select(*key, F.col("turn").alias("call_turn"), "needs"), "chat-heads")
    # The earliest result after the call.
    met = results.select(*key, "turn", "content").join(heads.select(*key, F.col("call_turn").alias("asked")), key, "left").withColumn("late", F.coalesce(F.col("turn") > F.col("asked"), F.lit(False)))
    # A result that isn't after its call is none for it: its name is left out of the ranking.
    met = met.withColumn("_for", F.when(F.col("late"), F.col("call_id")))
    results = staged(_ranked(met, ["conv_id", "_for"], F.struct("turn", F.coalesce("content", F.lit("")).alias("content"), F.col("content").isNull().alias("none")), "chat-results"), "chat-results")
    answers = results.filter("first").select(*key, F.struct("turn", "content", F.col("_cell.none").alias("none")).alias("answer"))
    wanted = heads.select(*key, F.explode(F.array_distinct("needs")).alias("need")).filter("need is not null")
    known = heads.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("known"))
    resolved = staged(wanted.join(known, ["conv_id", "need"], "left"), "chat-resolved")
    order = levels(heads.select(*key), resolved.filter("known").select(*key, "need"))
    lost = resolved.filter("known is null").groupBy(*key).agg(F.count("need").alias("lost"))
    rows = calls.withColumnRenamed("first", "is_first").withColumn("errors", argument_errors(F.col("name"), F.col("arguments"), tools))
    rows = rows.join(heads.select(*key, "call_turn", F.lit(True).alias("linkable")), key, "left").join(answers, key, "left").join(order, key, "left").join(lost, key, "left")
    first = F.col("is_first")
    notes = F.array(
        F.when(F.col("linkable").isNull(), F.lit("no id")),
        F.when(F.col("linkable") & ~first, F.lit("repeated id")),
        F.when(F.col("linkable") & F.col("level").isNull(), F.lit("circular")),
        F.when(F.col("lost") > 0, F.lit("unknown need")),
        F.when(first & F.col("answer").isNull(), F.lit("no result")),
    )
    rows = rows.withColumn("errors", F.concat("errors", F.filter(notes, lambda x: x.isNotNull())))
    value = F.try_parse_json("arguments")
    body = F.struct(
        value.alias("arguments"), F.col("call_id").alias("id"), "name", F.array_sort("needs").alias("needs"),
        F.when(first & ~F.col("answer.none"), F.col("answer.content")).alias("result"),
    )
    out = rows.select(
        *key, "name", F.col("turn").alias("call_turn"), F.when(first, F.col("answer.turn")).alias("result_turn"), F.when(first, F.col("level")).alias("level"),
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), F.to_json(body, {"ignoreNullFields": "false"}).alias("canonical"),
    )
    orphans = results.filter("not first")
    lone = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    none = lambda kind: F.lit(None).cast(kind)
    fault = F.when(F.col("late"), F.lit("repeated result")).otherwise(F.lit("no call"))
    orphans = orphans.select(*key, none("string").alias("name"), none("bigint").alias("call_turn"), F.col("turn").alias("result_turn"), none("int").alias("level"), F.lit(False).alias("valid"), fault.alias("errors"), lone.alias("canonical"))
    return out.unionByName(orphans)

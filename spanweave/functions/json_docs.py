"""JSON document functions over text columns.

What SQL functions can say stays in the JVM; edits, which have no built-in
counterpart, are Arrow functions over the tokens of a text (see json_scan);
the rows of children and of the whole tree are table functions.  Null JSON
gives null, malformed JSON an error unless stated otherwise.  Edits keep the
text of numbers and repeated keys as they are written; where values are read,
a document that repeats a key in one object is malformed unless the session
sets spark.sql.variant.allowDuplicateKeys, as Engine does, and then the last
one counts.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from .json_scan import Document, Malformed, merged, path_steps, quoted, steps_of

def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _is_json(x: Column) -> Column:
    """Whether a text is one JSON value; the built-in parser ignores what follows a value, so the text is also read inside brackets and braces."""
    inside = F.try_parse_json(F.concat(F.lit('{"x":'), x, F.lit("}")))
    return F.coalesce(F.try_parse_json(x).isNotNull() & inside.isNotNull() & (_length(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))) == 1), F.lit(False))


def _length(value: Column) -> Column:
    """How many items an array has, null for any other variant (Spark's own function of JSON text may be replaced in a session)."""
    return F.size(F.try_variant_get(value, "$", "array<variant>"))


def checked(x: Column | str) -> Column:
    """The text itself; an error if it is malformed."""
    x = _col(x)
    return F.when(~_is_json(x) & x.isNotNull(), F.raise_error(F.lit("malformed JSON")).cast("string")).otherwise(x)


def _at(x: Column, path: str) -> Column:
    """JSON text at a path without positions from the end, through get_json_object."""
    spelled = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path_steps(path))
    return x if spelled == "$" else F.get_json_object(x, spelled)


def _from_end(path: str) -> bool:
    return any(isinstance(s, tuple) for s in path_steps(path))


def _variant_at(x: Column, path: str) -> Column:
    """The variant at a path; positions from the end by the array that they stand in."""
    value, spelled = F.parse_json(x), "$"
    for step in path_steps(path):
        if isinstance(step, tuple):
            items = F.try_variant_get(value, spelled, "array<variant>")
            value, spelled = F.try_element_at(items, F.lit(-step[0])) if step[0] else F.lit(None).cast("variant"), "$"
        else:
            spelled += f"[{step}]" if isinstance(step, int) else f"['{step}']"
    return value if spelled == "$" else F.try_variant_get(value, spelled, "variant")


def _kind_of(value: Column) -> Column:
    """null, true, false, integer, real, text, array or object of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string")).when(kind == "VOID", "null").when(kind == "BOOLEAN", F.to_json(value)).when(kind == "BIGINT", "integer")
        .when(kind.rlike(r"^DECIMAL\(\d+,0\)"), "integer").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "real").when(kind == "STRING", "text").when(kind.startswith("ARRAY"), "array").otherwise("object")
    )


def _shown(value: Column) -> Column:
    """A variant as a SQL value: text bare, true and false as 1 and 0, containers as JSON."""
    kind, text = F.schema_of_variant(value), F.to_json(value)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "VOID", F.lit(None).cast("string")).when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).otherwise(text)


def json_valid(x: Column | str) -> Column:
    """1 or 0; null is not valid."""
    return _is_json(_col(x)).cast("int")


def json_array_length(x: Column | str, path: str = "$") -> Column:
    """0 for what is no array, null if there is nothing at the path."""
    x = checked(x)
    value = _variant_at(x, path)
    return F.when(value.isNotNull(), F.coalesce(_length(value), F.lit(0)))


def json_type(x: Column | str, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; null column value if nothing is there."""
    return _kind_of(_variant_at(_col(x), path))


def json_extract(x: Column | str, *paths: str) -> Column:
    """One path: the value as text (true and false as 1 and 0, containers as JSON); several: a JSON array."""
    x = checked(x)
    if len(paths) == 1:
        value = _variant_at(x, paths[0])
        if _from_end(paths[0]):
            return _shown(value)
        kind, found = F.schema_of_variant(value), _at(x, paths[0])
        return F.when(kind == "VOID", F.lit(None).cast("string")).when(kind == "BOOLEAN", F.when(found == "true", "1").otherwise("0")).otherwise(found)
    pieces = [F.coalesce(F.to_json(_variant_at(x, p)), F.lit("null")) for p in paths]
    return F.when(x.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *pieces), F.lit("]")))


def json_quote(v: Column | str) -> Column:
    """A SQL value as a JSON literal; null gives 'null'."""
    text = F.to_json(F.array(_col(v)))
    return F.coalesce(F.substr(text, F.lit(2), F.length(text) - 2), F.lit("null"))


def json_array(*values: Column | str) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[json_quote(v) for v in values]), F.lit("]"))


def json_object(*pairs: tuple[str | Column, Column | str]) -> Column:
    """From (label, value) pairs, in their order; nulls stay."""
    parts = [F.concat(json_quote(F.lit(k) if isinstance(k, str) else k), F.lit(":"), json_quote(v)) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_group_array(v: Column | str, *order: Column | str) -> Column:
    """Aggregate: a JSON array of all values with nulls, by `order`; '[]' without rows."""
    cells = F.collect_list(F.struct(*[_col(o) for o in order], json_quote(v).alias("_v")))
    items = F.transform(F.array_sort(cells) if order else cells, lambda c: c["_v"])
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_group_array_over(v: Column | str, window: Window) -> Column:
    """The same over a window frame, in its order."""
    return F.concat(F.lit("["), F.array_join(F.collect_list(json_quote(v)).over(window), ","), F.lit("]"))


def json_group_object(k: Column | str, v: Column | str, *order: Column | str) -> Column:
    """Aggregate: a JSON object, repeated labels kept; '{}' without rows."""
    cells = F.collect_list(F.struct(*[_col(o) for o in order], F.concat(json_quote(k), F.lit(":"), json_quote(v)).alias("_v")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(cells) if order else cells, lambda c: c["_v"]), ","), F.lit("}"))


def json_group_object_over(k: Column | str, v: Column | str, window: Window) -> Column:
    """The same over a window frame, in its order."""
    cells = F.collect_list(F.concat(json_quote(k), F.lit(":"), json_quote(v))).over(window)
    return F.concat(F.lit("{"), F.array_join(cells, ","), F.lit("}"))


# --- edits -----------------------------------------------------------------------------------------------------------

def _each(change: Callable, *columns: Column | str) -> Column:
    """Applies a function to the texts of each row; the first is the document, and none without it."""

    @F.arrow_udf("string")
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else change(*row) for row in zip(*[x.to_pylist() for x in arrays], strict=True)], pa.string())

    return run(*[_col(c) for c in columns])


def json_minify(x: Column | str) -> Column:
    """Valid JSON without white space; numbers, escapes and repeated keys stay as written."""
    return _each(_minified, x)


def _minified(text: str) -> str:
    return str(Document(text))


def _put_all(text: str, paths: Iterable[list], values: Iterable[str], create: bool, replace: bool) -> str | None:
    document, whole = Document(text), None
    for path, value in zip(paths, values, strict=True):
        if path and whole is None:
            document.put(path, value, create, replace)
        elif not path and replace:
            whole = value
    # A value that takes the whole document's place comes as it is.
    return str(document) if whole is None else Document(whole).shown(0)


def _remove_all(text: str, paths: Iterable[list]) -> str | None:
    document, gone = Document(text), False
    for path in paths:
        if not path:
            gone = True
        elif not gone:
            document.remove(path)
    return None if gone else str(document)


def _set(x: Column | str, pairs: tuple, create: bool, replace: bool) -> Column:
    if len(pairs) % 2:
        raise ValueError("paths and values come in pairs")
    paths = [path_steps(p) for p in pairs[::2]]
    # Values come as JSON of their columns, without white space.
    return _each(lambda text, *values: _put_all(text, paths, values, create, replace), x, *[json_quote(v) for v in pairs[1::2]])


def json_set(x: Column | str, *pairs: str | Column) -> Column:
    """Puts values at paths (path, value, path, value, ...), one after another, whether one is there or not.

    What one pair has put, later pairs of the call may replace, but don't change within.
    """
    return _set(x, pairs, True, True)


def json_insert(x: Column | str, *pairs: str | Column) -> Column:
    """Puts values only where none is."""
    return _set(x, pairs, True, False)


def json_replace(x: Column | str, *pairs: str | Column) -> Column:
    """Puts values only where one is."""
    return _set(x, pairs, False, True)


def json_remove(x: Column | str, *paths: str) -> Column:
    """Takes out what is at the paths, one after another; removing the root gives null."""
    steps = [path_steps(p) for p in paths]
    return _each(lambda text: _remove_all(text, steps), x)


def json_patch(x: Column | str, patch: Column | str) -> Column:
    """Merge patch: nulls delete, objects merge, anything else replaces."""
    return _each(lambda text, p: None if p is None else merged(text, p), x, patch)


# --- rows ------------------------------------------------------------------------------------------------------------


def _key_text(key: Column) -> Column:
    return F.when(key.rlike("^[A-Za-z][A-Za-z0-9]*$"), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('."'), key, F.lit('"')))


def json_each(df: DataFrame, x: str, prefix: str = "", path: str = "$") -> DataFrame:
    """`df` with a row for each child of the JSON in column `x` (of what lies at `path`): key, value, type, atom, fullkey and path.

    A scalar is its own row with a null key; nothing at the path gives none.
    The table is read once.
    """
    entry = lambda key, at, value: F.struct(key.alias("k"), at.alias("i"), value.alias("v"))
    no_key, no_place = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    kind = F.schema_of_variant("_doc")
    fields = F.transform(F.map_entries(F.expr("try_variant_get(_doc, '$', 'map<string,variant>')")), lambda e: entry(e["key"], no_place, e["value"]))
    items = F.transform(F.expr("try_variant_get(_doc, '$', 'array<variant>')"), lambda v, i: entry(no_key, i.cast("bigint"), v))
    cells = F.when(kind.startswith("OBJECT"), fields).when(kind.startswith("ARRAY"), items).when(F.col("_doc").isNotNull(), F.array(entry(no_key, no_place, F.col("_doc"))))
    rows = df.withColumn("_doc", _variant_at(F.col(x), path)).withColumn("_e", F.explode(cells))
    key, at, value = F.col("_e.k"), F.col("_e.i"), F.col("_e.v")
    root = F.lit(path)
    spelled = F.when(at.isNotNull(), F.concat(root, F.lit("["), at.cast("string"), F.lit("]"))).when(key.isNotNull(), F.concat(root, _key_text(key))).otherwise(root)
    name = _kind_of(value)
    own = {"key": F.coalesce(key, at.cast("string")), "value": _shown(value), "type": name, "atom": F.when(~name.isin("array", "object"), _shown(value)), "fullkey": spelled, "path": root}
    return rows.withColumns({prefix + k: v for k, v in own.items()}).drop("_doc", "_e")


class _Each:
    """Rows of the values in a document's object or array."""

    deep = False

    def eval(self, text: str | None, root: str | None = "$") -> Iterator[tuple]:
        if text is not None and root is not None:
            yield from Document(text).rows(root, self.deep)


class _Tree(_Each):
    """Rows of all of a document's values in the order in which they are written."""

    deep = True


_ROW = "key string, value string, type string, atom string, id int, parent int, fullkey string, path string"


def json_each_rows() -> UserDefinedTableFunction:
    """Table function (text[, path]) giving (key, value, type, atom, id, parent, fullkey, path) of the values at a path, to use with LATERAL.

    Unlike the columns of `json_each` it keeps the written order and repeated
    keys and has ids: the numbers of values and keys as they are written.
    """
    return F.udtf(_Each, returnType=_ROW)


def json_tree() -> UserDefinedTableFunction:
    """The same for what is at a path and all values in it."""
    return F.udtf(_Tree, returnType=_ROW)


# --- SQL -------------------------------------------------------------------------------------------------------------


def _sql_text(value) -> str:
    """A SQL value as JSON text."""
    if value is None or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, (str, datetime.date)):
        return quoted(str(value))
    return "true" if value is True else "false" if value is False else str(value)


def _sql_function(change: Callable, kind: pa.DataType = pa.string()) -> Callable:
    """A function over rows of SQL values as one over Arrow columns; a null document gives null."""

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([change(*row) for row in zip(*[x.to_pylist() for x in arrays], strict=True)], kind)

    return run


def _sql_edit(create: bool, replace: bool) -> Callable:
    def change(text: str | None, *pairs) -> str | None:
        if len(pairs) % 2:
            raise ValueError("paths and values come in pairs")
        # A null path or document gives null, as everywhere in SQL; a null value is JSON's.
        if text is None or None in pairs[::2]:
            return None
        return _put_all(text, map(steps_of, pairs[::2]), map(_sql_text, pairs[1::2]), create, replace)

    return change


def _sql_extract(text: str | None, *paths: str | None) -> str | None:
    if text is None or paths == (None,):
        return None
    document = Document(text)
    places = [-1 if p is None else document.find(steps_of(p)) for p in paths]
    if len(places) == 1:
        return document.shown(places[0]) if places[0] >= 0 else None
    return "[" + ",".join(document.text(at) if at >= 0 else "null" for at in places) + "]"


def _sql_at(read: Callable) -> Callable:
    def found(text: str | None, path: str | None = "$"):
        if text is None or path is None:
            return None
        document = Document(text)
        at = document.find(steps_of(path))
        return read(document, at) if at >= 0 else None

    return found


def _sql_valid(text: str | None) -> int:
    try:
        return int(text is not None and bool(Document(text)))
    except Malformed:
        return 0


def register_json(spark: SparkSession) -> None:
    """The functions as SQL has them, with as many arguments as a call gives.

    Reading: json_extract(x, path, ...), json_type(x[, path]), json_array_length(x[, path]), json_valid(x), json_quote(v).
    Making: json_array(v, ...), json_object(label, v, ...).
    Editing: json_minify(x), json_set, json_insert and json_replace(x, path, v, ...), json_remove(x, path, ...), json_patch(x, y).
    Table functions: json_each(x[, path]), json_tree(x[, path]).

    json_array_length takes the place of Spark's own of that name, for the session.
    """

    def made(*pairs) -> str:
        if len(pairs) % 2 or not all(isinstance(k, str) for k in pairs[::2]):
            raise ValueError("json_object() takes labels, which are text, and values in pairs")
        return "{" + ",".join(f"{quoted(k)}:{_sql_text(v)}" for k, v in zip(pairs[::2], pairs[1::2], strict=True)) + "}"

    whole = pa.int32()
    functions = {
        "json_extract": (_sql_extract, pa.string()), "json_type": (_sql_at(Document.kind), pa.string()), "json_array_length": (_sql_at(Document.length), whole),
        "json_valid": (_sql_valid, whole), "json_quote": (_sql_text, pa.string()), "json_array": (lambda *values: "[" + ",".join(map(_sql_text, values)) + "]", pa.string()), "json_object": (made, pa.string()),
        "json_minify": (lambda x: None if x is None else _minified(x), pa.string()), "json_patch": (lambda x, p: None if x is None or p is None else merged(x, p), pa.string()),
        "json_set": (_sql_edit(True, True), pa.string()), "json_insert": (_sql_edit(True, False), pa.string()), "json_replace": (_sql_edit(False, True), pa.string()),
        "json_remove": (lambda x, *paths: None if x is None or None in paths else _remove_all(x, map(steps_of, paths)), pa.string()),
    }
    for name, (change, kind) in functions.items():
        spark.udf.register(name, F.arrow_udf(_sql_function(change, kind), "int" if kind == whole else "string"))
    spark.udtf.register("json_each", json_each_rows())
    spark.udtf.register("json_tree", json_tree())

"""JSON text as its tokens: checked in one pass, looked into and edited by splicing, without a tree and without recursion.

A document is a list of tokens and, for each token that opens an object or
array, how many tokens follow up to its end, so that a path is found by
stepping over what isn't on it.  An edit replaces a run of tokens and corrects
the lengths of what encloses it; further edits go on from there.  Tokens stay
as they are written: numbers, escapes and repeated keys alike.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

#: Deeper nesting is malformed (fixed value).
DEEPEST = 2000
#: Texts up to so many characters are kept with their tokens, the latest so many of them.
_KEPT_CHARS, _KEPT_TEXTS = 1024, 1 << 13

_TOKENS = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|[{}\[\]:,]|true|false|null|[^ \t\n\r])').findall
_STEP = re.compile(r"""\.(?:"([^"]*)"|([^.\["]+))|\[(\d+)\]|\[#(?:-(\d+))?\]""")
_FIRST_OF_NUMBER = frozenset("-0123456789")
_LITERALS = frozenset(("true", "false", "null"))
_PLAIN_KEY = re.compile("[A-Za-z][A-Za-z0-9]*")
#: What may come next: a value; a value or the end of an array; a key or the end of an object; a key; a colon; a comma or an end.
_VALUE, _ITEM, _FIRST_KEY, _KEY, _COLON, _NEXT = range(6)


class Malformed(ValueError):
    def __init__(self):
        super().__init__("malformed JSON")


def path_steps(path: str) -> list[str | int | tuple[int]]:
    """Keys as text, positions as numbers, positions from the end as (n,)."""
    if not path.startswith("$"):
        raise ValueError(f"JSON path error near {path!r}")
    at, steps = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"JSON path error near {path[at:]!r}")
        quoted, key, position, back = m.groups()
        steps.append(quoted if quoted is not None else key if key is not None else int(position) if position is not None else (int(back or 0),))
        at = m.end()
    return steps


_steps = functools.lru_cache(4096)(path_steps)


def steps_of(path: str) -> list[str | int | tuple[int]]:
    """The steps of a path that comes with every row."""
    return _steps(path)


def _measured(tokens: list[str]) -> list[int]:
    """The lengths of objects and arrays; an error unless the tokens are one value."""
    sizes = [0] * len(tokens)
    opened: list[int] = []
    expected = _VALUE
    for i, token in enumerate(tokens):
        first = token[0]
        if expected == _NEXT:
            if not opened:
                raise Malformed
            is_object = tokens[opened[-1]] == "{"
            if first == ",":
                expected = _KEY if is_object else _VALUE
            elif first == ("}" if is_object else "]"):
                at = opened.pop()
                sizes[at] = i - at
            else:
                raise Malformed
        elif expected == _COLON:
            if first != ":":
                raise Malformed
            expected = _VALUE
        elif expected in (_KEY, _FIRST_KEY):
            if first == '"' and len(token) > 1:
                expected = _COLON
            elif first == "}" and expected == _FIRST_KEY:
                at = opened.pop()
                sizes[at] = i - at
                expected = _NEXT
            else:
                raise Malformed
        elif first in "{[":
            opened.append(i)
            if len(opened) > DEEPEST:
                raise Malformed
            expected = _FIRST_KEY if first == "{" else _ITEM
        elif first == "]" and expected == _ITEM:
            at = opened.pop()
            sizes[at] = i - at
            expected = _NEXT
        elif (first == '"' and len(token) > 1) or (first in _FIRST_OF_NUMBER and token != "-") or token in _LITERALS:
            expected = _NEXT
        else:
            raise Malformed
    if opened or expected != _NEXT:
        raise Malformed
    return sizes


def _scanned(text: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    tokens = _TOKENS(text)
    return tuple(tokens), tuple(_measured(tokens))


_kept = functools.lru_cache(_KEPT_TEXTS)(_scanned)


def _unquoted(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


class _Placed(str):
    """A value that an edit has put: one token, which further edits of the same call may replace but not enter."""


class Document:
    """The tokens of one JSON value."""

    __slots__ = ("tokens", "sizes")

    def __init__(self, text: str):
        tokens, sizes = _kept(text) if len(text) <= _KEPT_CHARS else _scanned(text)
        self.tokens, self.sizes = list(tokens), list(sizes)

    def __str__(self) -> str:
        return "".join(self.tokens)

    def text(self, at: int) -> str:
        """The value at a token, without white space."""
        return "".join(self.tokens[at : at + self.sizes[at] + 1])

    def children(self, at: int) -> Iterator[tuple[str | None, int]]:
        """The key token (None in an array) and place of each value in an object or array."""
        tokens, sizes = self.tokens, self.sizes
        end, j = at + sizes[at], at + 1
        is_object = tokens[at] == "{"
        while j < end:
            key, j = (tokens[j], j + 2) if is_object else (None, j)
            yield key, j
            j += sizes[j] + 2

    def _step(self, at: int, step: str | int | tuple[int]) -> int:
        """The place of a child, -1 if it isn't there; of a position just behind the last, -2; of none that can be, -3."""
        opening = self.tokens[at]
        if isinstance(step, str):
            if opening != "{":
                return -3
            return next((j for key, j in self.children(at) if key[1:-1] == step or ("\\" in key and _unquoted(key) == step)), -1)
        if opening != "[":
            return -3
        places = [j for _, j in self.children(at)]
        k = len(places) - step[0] if isinstance(step, tuple) else step
        return places[k] if 0 <= k < len(places) else -2 if k == len(places) else -3

    def find(self, steps: list) -> int:
        """The place of the value at a path, negative without one."""
        at = 0
        for step in steps:
            at = self._step(at, step)
            if at < 0:
                return -1
        return at

    def _splice(self, outer: list[int], start: int, stop: int, tokens: list[str], sizes: list[int]) -> None:
        self.tokens[start:stop], self.sizes[start:stop] = tokens, sizes
        for at in outer:
            self.sizes[at] += len(tokens) - (stop - start)

    def put(self, steps: list, value: str, create: bool, replace: bool) -> None:
        """Puts JSON text at a path below the root, where a value is (`replace`) or none is (`create`).

        Missing objects and arrays on the way are made.  What an earlier edit
        has put is not entered.
        """
        at, outer = 0, []
        for k, step in enumerate(steps):
            child = self._step(at, step)
            if child in (-1, -2):
                if create and (made := _wrapped(steps[k + 1 :], value)):
                    close = at + self.sizes[at]
                    start = [","] if self.sizes[at] > 1 else []
                    start += [quoted(step), ":"] if isinstance(step, str) else []
                    self._splice([*outer, at], close, close, start + made[0], [0] * len(start) + made[1])
                return
            if child < 0:
                return
            outer.append(at)
            at = child
        if replace:
            self._splice(outer, at, at + self.sizes[at] + 1, [_Placed(value)], [0])

    def remove(self, steps: list) -> None:
        """Takes out what is at a path below the root."""
        at, outer = 0, []
        for step in steps:
            outer.append(at)
            at = self._step(at, step)
            if at < 0:
                return
        start = at - 2 if isinstance(steps[-1], str) else at
        stop = at + self.sizes[at] + 1
        if self.tokens[stop] == ",":
            stop += 1
        elif self.tokens[start - 1] == ",":
            start -= 1
        self._splice(outer, start, stop, [], [])

    def kind(self, at: int) -> str:
        token = self.tokens[at]
        first = token[0]
        if first in "{[":
            return "object" if first == "{" else "array"
        if first == '"':
            return "text"
        return token if token in _LITERALS else "real" if any(c in token for c in ".eE") else "integer"

    def shown(self, at: int) -> str | None:
        """A value as SQL has it, as text: strings bare, true and false as 1 and 0, null as none."""
        token = self.tokens[at]
        if token[0] == '"':
            return _unquoted(token)
        return {"true": "1", "false": "0", "null": None}.get(token, self.text(at))

    def length(self, at: int) -> int:
        return sum(1 for _ in self.children(at)) if self.tokens[at] == "[" else 0

    def numbers(self) -> list[int]:
        """The number of each token's node: values and keys are counted in the order in which they are written."""
        out, n = [], -1
        for token in self.tokens:
            n += token not in "}],:"
            out.append(n)
        return out

    def rows(self, root: str, deep: bool) -> Iterator[tuple]:
        """(key, value, type, atom, id, parent, fullkey, path) of the values below a path; with `deep` of that at the path and of all below.

        A scalar at the path is its own row.
        """
        steps = steps_of(root)
        top = self.find(steps)
        if top < 0:
            return
        numbers = self.numbers()

        def row(key: str | None, at: int, parent: int | None, full: str, path: str) -> tuple:
            kind = self.kind(at)
            value = self.shown(at)
            return key, value, kind, None if kind in ("array", "object") else value, numbers[at], parent, full, path

        def below(at: int, full: str) -> Iterator[tuple[str, int, str]]:
            for k, (key, child) in enumerate(self.children(at)):
                if key is None:
                    yield str(k), child, f"{full}[{k}]"
                else:
                    name = _unquoted(key)
                    yield name, child, f"{full}.{name}" if _PLAIN_KEY.fullmatch(name) else f'{full}."{name}"'

        if not deep and self.tokens[top] in "{[":
            for key, at, full in below(top, root):
                yield row(key, at, None, full, root)
            return
        if not deep:
            yield row(None, top, None, root, root)
            return
        # What lies at a key is named by it where it holds more.
        named = self.tokens[top] in "{[" and bool(steps) and isinstance(steps[-1], str)
        stack = [(steps[-1] if named else None, top, None, root, root[: _last_step(root)] if steps else root)]
        while stack:
            key, at, parent, full, path = stack.pop()
            yield row(key, at, parent, full, path)
            if self.tokens[at] in "{[":
                stack.extend(reversed([(k, child, numbers[at], f, full) for k, child, f in below(at, full)]))


def _last_step(path: str) -> int:
    """Where the last step of a path begins."""
    at = last = 1
    while at < len(path):
        last, at = at, _STEP.match(path, at).end()
    return last


def _wrapped(steps: list, value: str) -> tuple[list[str], list[int]] | None:
    """A value inside new objects and arrays for a path; None where a path asks for more than the first of an array."""
    tokens, sizes = [_Placed(value)], [0]
    for step in reversed(steps):
        if isinstance(step, str):
            tokens, sizes = ["{", quoted(step), ":", *tokens, "}"], [len(tokens) + 3, 0, 0, *sizes, 0]
        elif step == 0:
            tokens, sizes = ["[", *tokens, "]"], [len(tokens) + 1, *sizes, 0]
        else:
            return None
    return tokens, sizes


class _Pairs(list):
    """[key token, value] pairs of an object; of a key that is repeated the first counts."""

    def at(self, key: str) -> int:
        name = _unquoted(key)
        return next((k for k, (own, _) in enumerate(self) if own == key or _unquoted(own) == name), -1)


def _objects(document: Document, at: int) -> _Pairs | str:
    """A value with its objects as pairs, arrays and scalars as text."""
    if document.tokens[at] != "{":
        return document.text(at)
    top = _Pairs()
    stack = [(top, at)]
    while stack:
        pairs, place = stack.pop()
        for key, child in document.children(place):
            if document.tokens[child] == "{":
                inner = _Pairs()
                pairs.append([key, inner])
                stack.append((inner, child))
            else:
                pairs.append([key, document.text(child)])
    return top


def _written(top: _Pairs | str) -> str:
    out: list[str] = []
    stack: list = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            out.append("{")
            stack.append("}")
            for k in reversed(range(len(x))):
                stack += [x[k][1], f"{',' if k else ''}{x[k][0]}:"]
    return "".join(out)


def merged(text: str, patch: str) -> str:
    """A merge patch: nulls delete, objects merge, anything else replaces."""
    change = _objects(Document(patch), 0)
    if isinstance(change, str):
        Document(text)
        return change
    top = _objects(Document(text), 0)
    top = top if isinstance(top, _Pairs) else _Pairs()
    open_ = [(top, change)]
    while open_:
        target, changes = open_.pop()
        for key, value in changes:
            at = target.at(key)
            if value == "null":
                if at >= 0:
                    del target[at]
                continue
            if isinstance(value, _Pairs):
                held = target[at][1] if at >= 0 else None
                inner = held if isinstance(held, _Pairs) else _Pairs()
                open_.append((inner, value))
                value = inner
            if at >= 0:
                target[at][1] = value
            else:
                target.append([key, value])
    return _written(top)

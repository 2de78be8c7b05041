"""Edit-aware token counts.

A document is cut into leaves at places where tokens surely part, whatever
stands further away: where a visible character meets white space, where
letters, digits and signs meet each other (but not behind an apostrophe), and,
where no such place is near, inside a run of letters, digits or signs between
two bytes that no token of the vocabulary holds side by side, so that no merge
spans them.  A tree over the leaves keeps
characters and tokens of every subtree.  An edit finds its leaves by walking
down the tree, takes in one leaf more on either side (a cut is only sure
while its surroundings stand), cuts and encodes those leaves anew and corrects
the sums on the way up; the rest of the document isn't encoded again.  Where
leaves crowd at one place, or most are gone, the tree is laid out again over
the leaves as they are, without encoding anything.

Edits are rows of an array column, applied in order; positions count code
points of the text as it then is.  A position beyond the end means the end, a
negative one the start, and a deletion stops at the end of the text.

Edge cases: a null text is empty and may be edited; a null list of edits has
none, null fields of an edit count as 0 or empty; repeated rows are counted
each; an empty table gives an empty result; columns besides doc_id, text and
edits are not read.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF_CHARS = 96
#: Leaves that one slot of the tree holds at most before the tree is laid out again.
CROWDED = 8
EDITS = "array<struct<pos: int, removed: int, added: string>>"

#: How the public byte-level vocabulary splits text into pre-tokens (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Where pre-tokens part, told by the two characters beside the place alone: no pre-token goes on from a visible character
#: to white space, nor from letters to digits or signs or back, but for the contractions, which begin with an apostrophe.
#: Signs are those that are surely neither white space nor parts of words; beside other characters nothing is cut.
_BORDER = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \t\n\r])|(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])|(?<=(?!')[\p{P}\p{S}])(?=[\p{L}\p{N}])")
#: Places inside a run; what begins with an apostrophe may be read as a contraction once it stands alone.
_INSIDE = regex.compile(r"(?<=\p{L})(?=\p{L})|(?<=\p{N})(?=\p{N})|(?<=[\p{P}\p{S}])(?=(?!')[\p{P}\p{S}])")


class Joined:
    """The pairs of bytes that some token holds side by side."""

    def __init__(self, tokens: Iterable[bytes]):
        self.held = bytearray(1 << 16)
        for token in tokens:
            for a, b in itertools.pairwise(token):
                self.held[a << 8 | b] = 1

    def __call__(self, before: str, after: str) -> bool:
        return bool(self.held[before.encode()[-1] << 8 | after.encode()[0]])


def _next_cut(text: str, start: int, stretch: int, joined: Joined | None) -> int | None:
    """The first sure cut from `start` on, stretch by stretch: where pre-tokens part, or else inside one."""
    for low in range(start, len(text), stretch):
        high = min(low + stretch, len(text))
        found = _BORDER.search(text, low, high)
        if found:
            return found.start()
        for inside in _INSIDE.finditer(text, low, high) if joined is not None else ():
            if not joined(text[inside.start() - 1], text[inside.start()]):
                return inside.start()
    return None


def leaves_of(text: str, size: int = LEAF_CHARS, joined: Joined | None = None) -> list[str]:
    """The text in leaves of about `size` characters, or longer where no sure cut is near."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _next_cut(text, at + size, size, joined)
        if cut is None:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


class SegmentTree:
    """Sums of characters and tokens over the leaves of one document, and the leaves themselves."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], size: int = LEAF_CHARS, joined: Joined | None = None):
        self.count, self.size, self.joined = count, size, joined
        self.encoded = 0
        self._build(self._counted(leaves_of(text, size, joined)))

    def _counted(self, leaves: list[str]) -> list[tuple[str, int]]:
        self.encoded += sum(map(len, leaves))
        return list(zip(leaves, self.count(leaves), strict=True))

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1
        while self.width < len(leaves):
            self.width *= 2
        self.held = len(leaves)
        # Each leaf slot holds a run of leaves, so that an edit never renumbers its neighbours.
        self.slots: list[list[tuple[str, int]]] = [[x] for x in leaves] + [[] for _ in range(self.width - len(leaves))]
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, run in enumerate(self.slots):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(len(x) for x, _ in run), sum(n for _, n in run)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _put(self, slot: int, run: list[tuple[str, int]]) -> None:
        self.slots[slot] = run
        i = self.width + slot
        self.chars[i], self.tokens[i] = sum(len(x) for x, _ in run), sum(n for _, n in run)
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, pos: int) -> tuple[int, int]:
        """The slot that holds position `pos`, and how many characters lie before that slot."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if pos - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def edit(self, pos: int, removed: int, added: str) -> None:
        length = self.chars[1]
        pos = min(max(pos, 0), length)
        removed = min(max(removed, 0), length - pos)
        if not removed and not added:
            return
        # The slots of the edit, and the next with text on either side.
        first, before = self._find(pos)
        if before:
            first, before = self._find(before - 1)
        last, start = self._find(min(pos + removed, max(length - 1, 0)))
        if start + self.chars[self.width + last] < length:
            last = self._find(start + self.chars[self.width + last])[0]
        leaves = [(s, leaf) for s in range(first, last + 1) for leaf in self.slots[s]]
        starts = [before]
        for _, (text, _) in leaves:
            starts.append(starts[-1] + len(text))
        # Leaves that the edit touches or borders on, and one more on either side.
        i = max(next(k for k in range(len(leaves)) if starts[k + 1] >= pos) - 1, 0)
        j = min(next(k for k in reversed(range(len(leaves))) if starts[k] <= pos + removed) + 1, len(leaves) - 1)
        region, at = "".join(text for _, (text, _) in leaves[i : j + 1]), pos - starts[i]
        fresh = self._counted(leaves_of(region[:at] + added + region[at + removed :], self.size, self.joined))
        home = leaves[i][0]
        runs: dict[int, list[tuple[str, int]]] = {s: [] for s, _ in leaves[i : j + 1]}
        for s, leaf in leaves[:i]:
            if s in runs:
                runs[s].append(leaf)
        runs[home] += fresh
        for s, leaf in leaves[j + 1 :]:
            if s in runs:
                runs[s].append(leaf)
        self.held += len(fresh) - (j + 1 - i)
        for s, run in runs.items():
            if len(run) <= CROWDED and 4 * self.held >= self.width:
                self._put(s, run)
            else:
                self.slots[s] = run
        if any(len(run) > CROWDED for run in runs.values()) or 4 * self.held < self.width:
            self._build([x for run in self.slots for x in run])

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(x for run in self.slots for x, _ in run)


def shared_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, sent to the tasks; its size is fixed."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def counter(vocabulary: bytes) -> tuple[Callable[[list[str]], list[int]], Joined]:
    """How many tokens each of some texts has, and the pairs that the vocabulary joins."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    encode = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda leaves: [len(encode(x)) for x in leaves], Joined(ranks)


def edited_counts(docs: DataFrame, ranks: Broadcast) -> DataFrame:
    """Rows (doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_edits, chars_reencoded) from (doc_id, text, edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, joined = counter(ranks.value)
        names = ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_edits", "chars_reencoded"]
        for batch in batches:
            out: list[list[int]] = [[] for _ in names[1:]]
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = SegmentTree(text.as_py() or "", count, joined=joined)
                before, encoded = tree.total, tree.encoded
                script = edits.as_py() or []
                for e in script:
                    if e is not None:
                        tree.edit(e["pos"] or 0, e["removed"] or 0, e["added"] or "")
                for column, value in zip(out, (before, tree.total, tree.chars[1], len(script), tree.encoded - encoded), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out]], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_edits long, chars_reencoded long")


def derived_edits(number: int = 4) -> Column:
    """A script of edits worked out from doc_id and the text's length: insertions, deletions, replacements."""
    words = F.array(*[F.lit(x) for x in ("", " corrected", "x", "\n\n", " 2024 ", "'ll", "é", " - ")])
    length = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))

    def one(i: int) -> Column:
        draw = F.xxhash64("doc_id", F.lit(i))
        return F.struct(F.pmod(draw, length).cast("int").alias("pos"), F.pmod(F.shiftright(draw, 17), F.lit(13)).cast("int").alias("removed"), F.element_at(words, (F.pmod(F.shiftright(draw, 33), F.lit(8)) + 1).cast("int")).alias("added"))

    return F.array(*[one(i) for i in range(number)])

"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens.  It begins as one state with an arc for every
byte that leads back to it, so it accepts every way to spell a text in bytes.
Each merge (a, b), in order of priority, is built in by a gadget: the state
that arcs labelled a lead to is copied without its arc b, the arcs a lead to
the copy, and every state with an arc a gets an arc ab that leads where b
led.  Behind a token a the token b can then no longer follow, and ab stands in
for the two.  After the last merge the automaton accepts exactly one sequence
of tokens for each text: the one that the merges give.

All arcs of one label lead to one state, so a state is an earlier state less
one label: the states form a tree, and a state lacks an arc t exactly where
one of its ancestors dropped t, or dropped a token that t grows from by its
left ends before t was made.  The arcs are kept in that form, as intervals of
the tree for each label (`Automaton.drops`): about one entry a merge in place
of a table of states by tokens.

A word is encoded from left to right by following arcs along its bytes.
Every prefix of a word has one accepted sequence, so a place in the word is
reached by one path and its state is known; a path that can't go on steps
back.  Decoding follows the arcs and emits their labels.

Edge cases: a null text is empty and has no tokens; a very long word is
encoded in time linear in its length; added tokens in a text are tokens of
their own, as the vocabulary file has them; ids outside the vocabulary are
left out by decoding; repeated rows give repeated rows; an empty table gives
an empty result; further columns are not read by `bpe_digest`, and `with_ids`
replaces a column of its own name.
"""

from __future__ import annotations

import hashlib
import json
import struct
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the vocabulary's library has it (fixed value): the Unicode property, without the separators 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How the byte-level vocabulary splits text into words (fixed value).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words that a task keeps with their ids in each of two generations, and the longest of them in bytes.
CACHED_WORDS, CACHED_BYTES = 1 << 18, 64
#: Arcs that a task keeps once they are looked up.
CACHED_ARCS = 1 << 20


class Vocabulary(NamedTuple):
    #: The bytes of each id.
    labels: dict[int, bytes]
    #: Pairs of ids and the id that they merge into, by priority.
    merges: list[tuple[int, int, int]]
    #: Texts that are tokens of their own, with their ids.
    added: dict[str, int]


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabulary files: itself, or the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(file: str) -> Vocabulary:
    """A byte-level vocabulary from the text of its JSON file; parts that would change the encoding raise an error."""
    content = json.loads(file)
    model, split = content["model"], content["pre_tokenizer"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if content["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or odd:
        raise ValueError(f"not a plain byte-level vocabulary: {odd or 'normalizer or pre-tokenizer'}")
    if any(a[k] for a in content["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in their surroundings aren't supported")
    signs = _byte_signs()
    added = {a["content"]: a["id"] for a in content["added_tokens"]}
    labels = {i: bytes(signs[c] for c in text) for text, i in model["vocab"].items() if text not in added}
    merges = []
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((model["vocab"][a], model["vocab"][b], model["vocab"][a + b]))
    return Vocabulary(labels | {i: text.encode() for text, i in added.items()}, merges, added)


class Automaton:
    """The compiled automaton: a state for each token, the drops of each label, and a trie of the labels."""

    def __init__(self, vocabulary: Vocabulary):
        self.labels = vocabulary.labels
        made = {i: (0, None) for i, label in vocabulary.labels.items() if len(label) == 1 and i not in set(vocabulary.added.values())}
        state = dict.fromkeys(made, 0)
        parent, dropped, at = [-1], [-1], [0]
        for time, (a, b, ab) in enumerate(vocabulary.merges, 1):
            # The gadget is void where a part was never made, the token stands already, or b can't follow a any more.
            if a not in state or b not in state or ab in state or self._lacks(state[a], b, made, parent, dropped, at):
                continue
            parent.append(state[a])
            dropped.append(b)
            at.append(time)
            state[ab] = state[b]
            state[a] = len(parent) - 1
            made[ab] = (time, a)
        self._compile(state, made, parent, dropped, at)

    @staticmethod
    def _lacks(q: int, t: int, made: dict, parent: list[int], dropped: list[int], at: list[int]) -> bool:
        """While building: whether the state has no arc t; any drop on the way up came before now."""
        # A drop of a token that t grows from counts where it came before the next token of that growth.
        spine, later = {}, None
        while t is not None:
            spine[t] = later
            later, t = made[t]
        while q > 0:
            if dropped[q] in spine and (spine[dropped[q]] is None or at[q] <= spine[dropped[q]]):
                return True
            q = parent[q]
        return False

    def _compile(self, state: dict, made: dict, parent: list[int], dropped: list[int], at: list[int]) -> None:
        children: list[list[int]] = [[] for _ in parent]
        for q in range(1, len(parent)):
            children[parent[q]].append(q)
        enter, leave, clock, stack = [0] * len(parent), [0] * len(parent), 0, [(0, False)]
        while stack:
            q, done = stack.pop()
            if done:
                leave[q] = clock
                continue
            enter[q], clock = clock, clock + 1
            stack.append((q, True))
            stack += [(c, False) for c in children[q]]
        #: The state behind each token, named by its place in the tree's order.
        self.behind = {t: enter[q] for t, q in state.items()}
        #: By label: the states that dropped it as intervals of the tree (rising starts, ends), and when. None holds another.
        grouped: dict[int, list[tuple[int, int, int]]] = {}
        for q in range(1, len(parent)):
            grouped.setdefault(dropped[q], []).append((enter[q], leave[q], at[q]))
        self.drops = {t: tuple(map(list, zip(*sorted(x), strict=True))) for t, x in grouped.items()}
        #: By label: the tokens that it grows from by its left ends, each with the time of the next growth.
        self.growth: dict[int, list[tuple[int, float]]] = {}
        for t in made:
            steps, later, u = [], float("inf"), t
            while u is not None:
                if u in self.drops:
                    steps.append((u, later))
                later, u = made[u]
            self.growth[t] = steps
        #: The trie of the labels: the following nodes of each node by byte, and the token that ends at it or -1.
        self.following: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for t in made:
            node = 0
            for byte in self.labels[t]:
                following = self.following[node].get(byte)
                if following is None:
                    following = self.following[node][byte] = len(self.ends)
                    self.following.append({})
                    self.ends.append(-1)
                node = following
            self.ends[node] = t

    def arc(self, q: int, t: int) -> bool:
        """Whether state q has an arc t."""
        for u, later in self.growth[t]:
            starts, ends, times = self.drops[u]
            k = bisect_right(starts, q) - 1
            if k >= 0 and q < ends[k] and times[k] <= later:
                return False
        return True


class Encoder(dict):
    """Words and their ids (little-endian, 32 bits), encoded as they are asked for.

    Two generations of words are kept within a bound: where the younger is
    full it becomes the elder, and what is asked for again is taken over.
    """

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.elder: dict[str, bytes] = {}
        self.arcs: dict[int, bool] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.elder.get(word)
        if ids is None:
            spelled = word.encode("utf-8")
            tokens = self.tokens(spelled)
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
            if len(spelled) > CACHED_BYTES:
                return ids
        if len(self) >= CACHED_WORDS:
            self.elder = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def tokens(self, word: bytes) -> list[int]:
        """The labels of the accepted path.

        Longer arcs are tried first and the path steps back where none goes
        on.  A place is reached by one accepted path alone, so one that led
        nowhere is never tried again: the time is linear in the length.
        """
        machine, arcs = self.automaton, self.arcs
        following, ends, behind = machine.following, machine.ends, machine.behind
        n, path, dead = len(word), [], set()
        i = q = 0
        while i < n:
            node, tried = 0, []
            for j in range(i, n):
                node = following[node].get(word[j])
                if node is None:
                    break
                t = ends[node]
                if t >= 0:
                    tried.append((j + 1, t))
            while True:
                while tried:
                    j, t = tried.pop()
                    if j in dead:
                        continue
                    key = q << 20 | t
                    there = arcs.get(key)
                    if there is None:
                        if len(arcs) >= CACHED_ARCS:
                            arcs.clear()
                        there = arcs[key] = machine.arc(q, t)
                    if there:
                        break
                else:
                    # Nothing goes on from here: back to the place before.
                    dead.add(i)
                    i, q, _, tried = path.pop()
                    continue
                path.append((i, q, t, tried))
                i, q = j, behind[t]
                break
        return [t for _, _, t, _ in path]


def shared_automaton(spark: SparkSession, path: str) -> Broadcast:
    """The automaton, compiled once and sent to the tasks; its size follows the vocabulary's and not the data's."""
    with open(path, encoding="utf-8") as f:
        vocabulary = read_vocabulary(f.read())
    return spark.sparkContext.broadcast((Automaton(vocabulary), vocabulary.added))


class Codec:
    """Encodes texts to packed ids and decodes them, for one task."""

    def __init__(self, automaton: Automaton, added: dict[str, int]):
        import regex

        self.words = Encoder(automaton)
        self.labels = automaton.labels
        self.find = regex.compile(PATTERN).findall
        self.added = {text: np.array([i], dtype="<u4").tobytes() for text, i in added.items()}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str) -> bytes:
        parts = self.parts.split(text) if self.parts and any(a in text for a in self.added) else (text,)
        return b"".join([x for k, part in enumerate(parts) for x in ((self.added[part],) if k % 2 else map(self.words.__getitem__, self.find(part)))])

    def decode(self, ids: bytes) -> str:
        """The text that the labels spell; bytes that are no UTF-8 become replacement characters."""
        label = self.labels.get
        return b"".join([label(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def bpe_digest(docs: DataFrame, automaton: Broadcast) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) from (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*automaton.value)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, automaton: Broadcast) -> DataFrame:
    """`docs` with `ids` (array of int) in place of `text`."""
    rows = docs.drop("ids")
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + ["ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*automaton.value)
        for batch in batches:
            ids = [np.frombuffer(codec.encode(t.as_py() or ""), dtype="<u4").astype(np.int32) for t in batch.column(len(kept))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(kept))], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], [*kept, "ids"])

    return rows.select(*kept, F.col("text").cast("string")).mapInArrow(run, schema)


def decoded(rows: DataFrame, automaton: Broadcast) -> DataFrame:
    """Rows (doc_id, text) from (doc_id, ids): the labels of the ids one after another; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*automaton.value)
        for batch in batches:
            texts = [codec.decode(np.array([i for i in ids.as_py() or [] if i is not None], dtype="<u4").tobytes()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")

"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a SentencePiece vocabulary file, read by the driver and
sent to the tasks as arrays (their size is that of the vocabulary).  The
public file ranks its pieces but holds no probabilities, so log scores follow
Zipf's law from the ranks; `scores="file"` takes the file's own values, for
vocabularies that hold log scores.  A blank becomes the marker U+2581, one
marker is put before the text, and characters without a piece fall back to
byte pieces.

No piece crosses from another character into a marker (checked when the
vocabulary is read), nor from a word into certain punctuation (worked out
from the pieces), so a text splits there and each stretch is segmented on its
own, best path first found winning ties; a task remembers stretches that it
has segmented, up to a fixed number.

Edge cases: null and empty texts have no pieces and decode to an empty text;
U+2581 in a text is the same as a blank; ids outside the vocabulary decode to
nothing and byte pieces that form no UTF-8 to U+FFFD; very long stretches
take time linear in their length; repeated rows repeat their result; an empty
table gives an empty result; other columns of the input pass through
`with_pieces`, which replaces columns of its own names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "▁"
#: The unknown penalty and Zipf offset of the scores.
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000

# Piece kinds in a vocabulary file (fixed values).
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


class Vocabulary(NamedTuple):
    """The double array (base, check, value by node), scores by id, bytes by id."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    surface: list[bytes]  # what an id decodes to, markers as blanks
    byte_ids: list[int]
    unknown: float
    openers: str  # punctuation that no piece has right after a letter or digit


_ALNUM = r"[^\W_]"


def _openers(pieces: list[str]) -> str:
    """Punctuation that no piece has right after a letter or digit: a text may be cut there."""
    inner = {y for piece in pieces for x, y in zip(piece, piece[1:], strict=False) if re.match(_ALNUM, x)}
    return "".join(c for c in "\n\t\r!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~" if c not in inner)


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie in two arrays: the child of node s by byte c is t = base[s] + c + 1 where check[t] == s."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    keys, values = [keys[i] for i in order], [values[i] for i in order]
    size = 1 << 10
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    hole, front = 1, 1  # where a lone child and where several children are looked for
    pending = [(0, 0, len(keys), 0)]
    while pending:
        node, lo, hi, depth = pending.pop()
        if lo < hi and len(keys[lo]) == depth:
            value[node] = values[lo]
            lo += 1
        children, i = [], lo
        while i < hi:
            c, j = keys[i][depth], i + 1
            while j < hi and keys[j][depth] == c:
                j += 1
            children.append((c + 1, i, j))
            i = j
        if not children:
            continue
        while max(hole, front) + 600 > len(check):
            base += [0] * len(base)
            value += [-1] * len(value)
            check += [-1] * len(check)
        first = children[0][0]
        if len(children) == 1:
            while check[hole] != -1 or hole < first:
                hole += 1
            b = hole - first
        else:
            b, tries = max(front - first, 0), 0
            while any(check[b + c] != -1 for c, _, _ in children):
                b, tries = b + 1, tries + 1
                if b + 300 > len(check):
                    base += [0] * len(base)
                    value += [-1] * len(value)
                    check += [-1] * len(check)
            if tries > 50:  # too full hereabouts: leave the holes to lone children
                front = b + first
        base[node] = b
        for c, i, j in children:
            check[b + c] = node
            pending.append((b + c, i, j, depth + 1))
    end = max(i for i, x in enumerate(check) if x != -1) + 300
    grow = lambda x, fill: np.array((x + [fill] * 600)[:end], np.int32)
    return grow(base, 0), grow(check, -1), grow(value, -1)


def read_vocabulary(path: str, scores: str = "zipf") -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model = model_pb2.ModelProto()
    model.ParseFromString(Path(path).read_bytes())
    kinds = [p.type for p in model.pieces]
    plain = [i for i, k in enumerate(kinds) if k in (NORMAL, USER_DEFINED)]
    crossing = [model.pieces[i].piece for i in plain if re.search(f"[^{MARKER}]{MARKER}", model.pieces[i].piece)]
    if crossing:
        raise ValueError(f"pieces that cross into a marker aren't supported: {crossing[:3]}")
    score = np.full(len(kinds), -np.inf)
    harmonic = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
    for rank, i in enumerate(plain, 1):
        score[i] = np.float32(-math.log(rank) - harmonic if scores == "zipf" else model.pieces[i].score)
    surface, byte_ids = [], [-1] * 256
    for i, p in enumerate(model.pieces):
        if kinds[i] == BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            surface.append(bytes([int(p.piece[3:5], 16)]))
        else:
            surface.append(p.piece.replace(MARKER, " ").encode() if kinds[i] in (NORMAL, USER_DEFINED) else b"")
    base, check, value = double_array([model.pieces[i].piece.encode() for i in plain], plain)
    return Vocabulary(base, check, value, score, surface, byte_ids, float(score[plain].min()) - UNKNOWN_PENALTY, _openers([model.pieces[i].piece for i in plain]))


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.base, self.check, self.value, self.score = (x.tolist() for x in vocabulary[:4])
        self.known: dict[str, bytes] = {}
        p = re.escape(vocabulary.openers) or MARKER
        more = f"[^{MARKER}{p}]+|(?<!{_ALNUM})[{p}]+"
        self.stretches = re.compile(f"{MARKER}*(?:{more})++|[{p}]+(?:{more})*+|{MARKER}+")

    def segment(self, stretch: str) -> list[int]:
        """Ids of the best path, as a list."""
        text = stretch.encode()
        n = len(text)
        base, check, value, score = self.base, self.check, self.value, self.score
        lowest = -math.inf
        best, back, by = [lowest] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            if here == lowest:
                continue
            lead = text[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, end, single = 0, start, False
            while end < n:
                t = base[node] + text[end] + 1
                if check[t] != node:
                    break
                node, end = t, end + 1
                piece = value[t]
                if piece >= 0:
                    s = here + score[piece]
                    if s > best[end]:
                        best[end], back[end], by[end] = s, start, piece
                    single = single or end == start + width
            if not single:
                end = start + width
                s = here + self.v.unknown
                if s > best[end]:
                    best[end], back[end], by[end] = s, start, -1
        ids, end = [], n
        while end > 0:
            start = back[end]
            if by[end] >= 0:
                ids.append(by[end])
            else:
                ids.extend(self.v.byte_ids[b] for b in reversed(text[start:end]))
            end = start
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        stretches = self.stretches.findall(MARKER + text.replace(" ", MARKER))
        out = []
        for s in stretches:
            ids = known.get(s)
            if ids is None:
                ids = np.array(self.segment(s), np.int32).tobytes()
                if len(s) < 64 and len(known) <= REMEMBERED:
                    known[s] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        surface, n = self.v.surface, len(self.v.surface)
        raw = b"".join([surface[i] for i in ids.tolist() if 0 <= i < n])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def shared_vocabulary(spark: SparkSession, path: str, scores: str = "zipf") -> Broadcast:
    return spark.sparkContext.broadcast(read_vocabulary(path, scores))


def with_pieces(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """`docs` with `pieces` (array<int>): the ids of each text."""
    names = [c for c in docs.columns if c != "pieces"]
    rows = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    at = names.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                ids = [codec.encode(t) for t in batch.column(at).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "pieces"])

    return rows.mapInArrow(encode, T.StructType([*rows.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(doc_id, text) from (doc_id, pieces)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in batches:
            texts = [codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "pieces").mapInArrow(decode, "doc_id long, text string")


def piece_digest(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Rows (doc_id, n_pieces, n_byte_pieces, pieces_crc, round_trip): each text is encoded and decoded again.

    pieces_crc is the crc32 of the ids as little-endian 32-bit integers;
    round_trip says whether decoding gives the text back (markers as blanks).
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        is_byte = np.zeros(len(codec.v.surface) + 1, bool)
        is_byte[[i for i in codec.v.byte_ids if i >= 0]] = True
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids = codec.encode(text)
                rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), codec.decode(ids) == text.replace(MARKER, " ")))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(columns[i], pa.int64()) for i in range(3)], pa.array(columns[3], pa.bool_())], ["doc_id", "n_pieces", "n_byte_pieces", "pieces_crc", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_pieces long, n_byte_pieces long, pieces_crc long, round_trip boolean")

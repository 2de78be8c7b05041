"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are grouped by their content (see text_runs), and for each
distinct text the byte offsets of its code points are kept as an Elias-Fano
list: the low bits of each offset packed side by side, the high bits as a
unary bit string with sampled positions of its ones, so that the place of any
cut is found in a few steps without walking the text.  The list is made at
the first document of a run and joined to the others by a merge in sorted
order; a run that spans partitions makes it once in each, and nothing larger
than one text and its list is held.

Each document's cuts and form are drawn from sha256 of its doc_id, so they
don't depend on how rows are dealt out.  The text is rebuilt from what was
written and its form, not taken over.

Edge cases: a null text is empty; an empty text or one that holds a sentinel
is left plain; a null doc_id draws as an id without digits; repeated rows
give repeated rows; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_runs import rows_with_starts, sorted_by_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Percent of texts that are cut, and of these in suffix-prefix-middle order.
CUT_PERCENT, SPM_PERCENT = 90, 20
_SAMPLE = 256
_BATCH = 2048
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary()), ("restored", pa.binary())])


class EliasFano:
    """A rising list of integers in about 2 + log2(last / length) bits each, with direct access."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        last = int(values[-1]) if self.n else 0
        self.low_bits = max((last // max(self.n, 1)).bit_length() - 1, 0)
        high = (values >> self.low_bits) + np.arange(self.n)
        bits = np.zeros(int(high[-1]) + 1 if self.n else 0, dtype=np.uint8)
        bits[high] = 1
        self.high = np.packbits(bits)
        self.samples = high[::_SAMPLE].astype(np.uint32)
        low = values & ((1 << self.low_bits) - 1)
        self.low = np.packbits(((low[:, None] >> np.arange(self.low_bits)) & 1).astype(np.uint8)) if self.low_bits else None

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The value at index i: its high part is the place of the i-th one less the ones before it."""
        at = int(self.samples[i // _SAMPLE])
        rest = i % _SAMPLE
        while rest:
            # The bits behind `at`, a stretch at a time; it holds the wanted one or is passed whole.
            start = (at + 1) >> 3
            ones = np.flatnonzero(np.unpackbits(self.high[start : start + _SAMPLE // 4])[(at + 1) & 7 :])
            if len(ones) >= rest:
                at += 1 + int(ones[rest - 1])
                break
            rest -= len(ones)
            at = ((start + _SAMPLE // 4) << 3) - 1
        value = (at - i) << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.low[bit >> 3]) >> (7 - (bit & 7)) & 1) << k
        return value


class TextIndex(NamedTuple):
    """What is worked out once for a distinct text in UTF-8."""

    text: bytes
    boundaries: EliasFano
    whole: bool

    @classmethod
    def of(cls, text: bytes) -> TextIndex:
        units = np.frombuffer(text, dtype=np.uint8)
        starts = np.flatnonzero((units & 0xC0) != 0x80)
        held = any(s in text for s in (PREFIX, SUFFIX, MIDDLE))
        return cls(text, EliasFano(np.append(starts, len(text))), held or not text)

    @property
    def n(self) -> int:
        return len(self.boundaries) - 1


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the seed and the decimal id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transformed(index: TextIndex, doc_id: int | None, seed: int = SEED) -> tuple[str, int | None, int | None, bytes]:
    """(form, prefix_chars, middle_chars, output) of one document with this text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if index.whole or h3 % 100 >= CUT_PERCENT:
        return "plain", None, None, index.text
    one, two = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    a, b = index.boundaries.select(one), index.boundaries.select(two)
    prefix, middle, suffix = index.text[:a], index.text[a:b], index.text[b:]
    if h4 % 100 < SPM_PERCENT:
        return "spm", one, two - one, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return "psm", one, two - one, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text from what was written for it; no part holds a sentinel and none overlaps another."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, seed: int = SEED, digests: bool = False) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output, restored), texts as strings.

    With `digests` the two texts are their sha256 in lowercase hex, worked out
    where they are made, so that no text is sent back from the tasks.
    """
    names = [f.name for f in _SCHEMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        index, size = None, 0
        for row in rows_with_starts(batches):
            if row.starts:
                index = TextIndex.of(row.text)
            form, prefix, middle, output = transformed(index, row.doc_id, seed)
            back = restored(output, form)
            if digests:
                output, back = (hashlib.sha256(x).hexdigest().encode() for x in (output, back))
            out.append((row.doc_id, index.n, form, prefix, middle, output, back))
            size += len(output) + len(back)
            if len(out) >= _BATCH or size >= 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], names)

    made = sorted_by_text(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary")
    return made.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def digest_columns() -> list[Column]:
    """The columns of `fill_in_middle(digests=True)` under the names of digests."""
    return [F.col(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")] + [F.col("output").alias("output_sha256"), F.col("restored").alias("restored_sha256")]

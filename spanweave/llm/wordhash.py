"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes outside a separator set.  Each word gets a
64-bit multilinear hash (sum of byte value times a per-position random
multiplier, then mixed).  Everything is numpy over the column's byte buffer;
rows are taken in slices of bounded size so that memory does not follow the
Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_POSITIONS = 4096

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIERS = mix(np.arange(1, _POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Slice(NamedTuple):
    """Rows [first, first + rows) of a batch."""

    first: int
    rows: int
    data: np.ndarray  # the rows' bytes, one after another
    row_at: np.ndarray  # rows + 1 offsets into data
    hashes: np.ndarray  # one per word
    word_at: np.ndarray  # rows + 1 offsets into hashes


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.cast(pa.large_binary()).fill_null(b"")
    n = len(flat)
    if n == 0:
        return
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + n + 1]
    body = flat.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def hash_words(data: np.ndarray, row_at: np.ndarray, separators: np.ndarray = WHITESPACE, fold: np.ndarray | None = ASCII_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and each row's offsets into them."""
    word = ~separators[data]
    at = np.flatnonzero(word)
    if at.size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(row_at), np.int64)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = row_at[row_at < len(data)]
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    firsts = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(firsts, at.size))
    position = np.arange(at.size, dtype=np.int64) - np.repeat(firsts, lengths)
    letters = data[at] if fold is None else fold[data[at]]
    if lengths.max() <= _POSITIONS:
        factor = _MULTIPLIERS[position]
    else:
        factor = _MULTIPLIERS[position % _POSITIONS] * (mix((position // _POSITIONS).astype(np.uint64)) | np.uint64(1))
    value = (letters.astype(np.uint64) + np.uint64(1)) * factor
    hashes = mix(np.add.reduceat(value, firsts) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, row_at).astype(np.int64)


def hashed_slices(column: pa.Array, separators: np.ndarray = WHITESPACE, fold: np.ndarray | None = ASCII_LOWER) -> Iterator[Slice]:
    for first, data, row_at in byte_slices(column):
        hashes, word_at = hash_words(data, row_at, separators, fold)
        yield Slice(first, len(row_at) - 1, data, row_at, hashes, word_at)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` consecutive entries (runs may cross rows)."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * _MULTIPLIERS[100 + j]
    return mix(total)

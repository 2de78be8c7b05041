"""Nucleotide text: reverse complement and the two-bit code.

A two-bit value is a struct (bits binary, txt string) with one field set: text
that is all nucleotides is coded, other ASCII text is kept as it is.  Coded
bytes: the number of unused places in the last byte, then four nucleotides a
byte from the high bits down; a single nucleotide is one byte without that
count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWOBIT = "struct<bits: binary, txt: string>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dna_revcomp(s: Column | str) -> Column:
    """Reverse complement, case kept; anything but ACGT is an error."""
    s = _col(s)
    bad = F.raise_error(F.lit("non-DNA input to dna_revcomp()")).cast("string")
    return F.when(s.rlike("[^ACGTacgt]"), bad).otherwise(F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca")))


#: Two base-4 digits read as one UTF-16 character, and the hexadecimal digit that they make: one pass over a text of any length.
HEX = "0123456789ABCDEF"
PAIRS = "".join(chr(ord(HEX[k // 4]) << 8 | ord(HEX[k % 4])) for k in range(16))


def nucleotides_twobit(s: Column | str) -> Column:
    """Codes DNA or RNA text; each pair of nucleotides becomes one hexadecimal digit."""
    s = _col(s)
    n = F.length(s)
    digits = F.translate(F.upper(s), "TUCAG", "00123")
    padded = F.call_function("rpad", digits, (F.ceil(n / 4) * 4).cast("int"), F.lit("0"))
    body = F.translate(F.decode(F.encode(padded, "US-ASCII"), "UTF-16BE"), PAIRS, HEX)
    head = F.lpad(F.hex(F.pmod(4 - n % 4, F.lit(4))), 2, "0")
    bits = F.unhex(F.when(n == 1, F.lpad(digits, 2, "0")).otherwise(F.concat(head, body)))
    code, kept = (lambda v: F.struct(v.alias("bits"), F.lit(None).cast("string").alias("txt"))), F.struct(F.lit(None).cast("binary").alias("bits"), s.alias("txt"))
    bad = F.raise_error(F.lit("nucleotides_twobit(): text isn't ASCII")).cast(TWOBIT)
    return F.when(s.isNull(), F.lit(None).cast(TWOBIT)).when(s.rlike(r"[^\x01-\x7F]"), bad).when((s == "") | s.rlike("[^ACGTUacgtu]"), kept).otherwise(code(bits))


def twobit_length(x: Column | str) -> Column:
    """Number of nucleotides; for kept text, its bytes."""
    x = _col(x)
    bits = x["bits"]
    size = F.octet_length(bits)
    pad = F.conv(F.hex(F.substring(bits, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(3))
    return F.when(bits.isNull(), F.octet_length(x["txt"])).when(size < 2, size).otherwise(4 * (size - 1) - pad)


def _decoded(bits: Column, letters: str) -> Column:
    size = F.octet_length(bits)
    pad = F.conv(F.hex(F.substring(bits, 1, 1)), 16, 10).cast("int")
    pairs = F.translate(F.substr(F.hex(bits), F.lit(3)), HEX, PAIRS)
    full = F.translate(F.decode(F.encode(pairs, "UTF-16BE"), "US-ASCII"), "0123", letters)
    single = F.translate(F.conv(F.hex(bits), 16, 10), "0123", letters)
    return F.when(size < 2, single).otherwise(F.substr(full, F.lit(1), 4 * (size - 1) - pad))


def _slice(length: Column, y: Column, z: Column | None) -> tuple[Column, Column]:
    """Zero-based offset and count for a start `y` and count `z` that may be zero or negative.

    A start of 0 counts one place before the text; a negative start counts
    from the end; a negative count takes what stands before the start.
    """
    offset = F.when(y > 0, y - 1).when(y < 0, F.greatest(F.lit(0), y + length)).otherwise(0)
    if z is None:
        return offset, length
    before = F.least(offset, -z, length)
    lost = F.when(y == 0, 1).when((y < 0) & (-y > length), -y - length).otherwise(0)
    start = F.when(z < 0, offset - F.least(offset, -z)).otherwise(offset)
    count = F.when(z < 0, before).when(z.isNull(), length).otherwise(F.greatest(F.lit(0), z - lost))
    return F.when(z.isNull(), offset).otherwise(start), count


def text_slice(s: Column | str, y: Column, z: Column | None = None) -> Column:
    """Substring of a text with the start and count rules above."""
    s = _col(s)
    offset, count = _slice(F.length(s), y, z)
    return F.substr(s, (offset + 1).cast("int"), count.cast("int"))


def _twobit_text(x: Column | str, letters: str, y: Column | int | None, z: Column | int | None) -> Column:
    x = _col(x)
    y, z = (F.lit(v) if isinstance(v, int) else v for v in (y, z))
    full = F.when(x["bits"].isNotNull(), _decoded(x["bits"], letters)).otherwise(x["txt"])
    if y is None:
        return full
    offset, count = _slice(twobit_length(x), y, z)
    start, count = (offset + 1).cast("int"), count.cast("int")
    # Kept text is cut by bytes.
    kept = F.decode(F.substr(F.encode(x["txt"], "utf-8"), start, count), "utf-8")
    return F.when(x["bits"].isNotNull(), F.substr(_decoded(x["bits"], letters), start, count)).otherwise(kept)


def twobit_dna(x: Column | str, y: Column | int | None = None, z: Column | int | None = None) -> Column:
    """Text of a two-bit value with T, or a part of it; kept text comes as it is."""
    return _twobit_text(x, "TCAG", y, z)


def twobit_rna(x: Column | str, y: Column | int | None = None, z: Column | int | None = None) -> Column:
    """The same with U."""
    return _twobit_text(x, "UCAG", y, z)

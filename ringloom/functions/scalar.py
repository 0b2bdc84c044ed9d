"""Column expressions of the codecs' arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ring of the LF2 codec: its size, and where writing starts.
RING, RING_START = 4096, 0x0FEE


def ring_position(cursor: Column) -> Column:
    """Write position when ``cursor`` bytes are out."""
    return (cursor + RING_START).bitwiseAND(F.lit(RING - 1))


def ring_distance(head: Column, pos: Column) -> Column:
    """How far back a ring position lies; the head's own position (a whole turn back) has distance 0."""
    return F.pmod(head - pos, F.lit(RING))


def wrapping_sub(a: Column, b: Column) -> Column:
    """Difference of unsigned bytes."""
    return F.pmod(a - b, F.lit(256))


def signed_offset(distance: Column, width: int) -> tuple[Column, Column]:
    """A linear distance as rows and columns; a column beyond half the width counts from the next row."""
    row, col = F.floor(distance / width), F.pmod(distance, F.lit(width))
    far = col > width // 2
    return F.when(far, row + 1).otherwise(row), F.when(far, col - width).otherwise(col)


def hex_text(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def unhex_text(text: Column) -> Column:
    """A number written as hex digits, with or without 0x; null if it is none."""
    digits = F.regexp_extract(F.trim(text), "^(?:0[xX])?([0-9a-fA-F]+)$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def bytes_of(binary: Column) -> Column:
    """The bytes of a binary column as an array of ints."""
    # the pairs of digits are cut once; a lambda that cut its own pair would write out all digits again for each byte
    return F.transform(F.regexp_extract_all(F.hex(binary), F.lit(".."), F.lit(0)), lambda p: F.conv(p, 16, 10).cast("int"))


def little_endian(binary: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number of ``size`` bytes at byte offset ``at``; null where the column is too short."""
    value = sum((F.conv(F.hex(F.substring(binary, at + i + 1, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(size)), F.lit(0).cast("long"))
    return F.when(F.octet_length(binary) >= at + size, value)


def framed_size(is_match: Column) -> Column:
    """Bytes that a group's tokens take: a flag byte for every eight, one for a literal, two for a match."""
    n, m = F.count("*"), F.count_if(is_match)
    return (F.floor((n + 7) / 8) + (n - m) + 2 * m).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]+)?$", 1)

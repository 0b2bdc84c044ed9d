"""PAK archives in column expressions: key, table of members, and members' bytes.

An archive ends in a table of 24 bytes for each member. All of it is shifted by a key of 11 bytes that repeats: the byte at offset ``i`` of the
table, or of a member, has the key's byte ``i mod 11`` added.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.functions.scalar import bytes_of, little_endian
from ringloom.sources import batch

MAGIC, ENTRY, KEY = b"LEAFPACK", 24, 11
#: Known archives by their number of members (fixed values of the format).
KINDS = {0x0248: "ToHeart", 0x03E1: "ToHeart", 0x01FB: "Kizuato"}


def archive_kind(count: Column) -> Column:
    out = F.lit("Unknown")
    for n, name in KINDS.items():
        out = F.when(count == n, name).otherwise(out)
    return out


def key_bytes(table: Column) -> Column:
    """The key from the table's first three entries, whose padding and positions are known (fixed rule of the format): each byte is a table byte,
    or a difference of two of them on top of an earlier byte of the key."""
    b = lambda i: F.get(table, F.lit(i))
    k: list[Column] = [b(11), b(12) - 10, b(13), b(14), b(15)]
    for plus, minus, base in ((38, 22, 0), (39, 23, 1), (62, 46, 2), (63, 47, 3), (20, 36, 3), (21, 37, 4)):
        k.append(b(plus) - b(minus) + k[base])
    return F.array(*[F.pmod(x, F.lit(256)) for x in k])


def shifted(data: bytes, key: Sequence[int]) -> bytes:
    """Bytes with the key's added, which repeat."""
    return (np.frombuffer(data, np.uint8) + np.resize(np.array(list(key), np.int64), len(data))).astype(np.uint8).tobytes()


def unshift(values: Column, key: Column) -> Column:
    """Take the key away from an array of bytes."""
    return F.transform(values, lambda v, i: F.pmod(v - F.get(key, F.pmod(i, F.lit(KEY))), F.lit(256)))


def _number(values: Column, at: Column | int, size: int) -> Column:
    return sum((F.get(values, F.lit(i) + at).cast("long") * (1 << 8 * i) for i in range(size)), F.lit(0).cast("long"))


def _name(values: Column, at: Column) -> Column:
    """Eight characters up to a blank or zero, a dot, three characters without zeros."""
    text = lambda a, n: F.array_join(F.transform(F.slice(values, at + a + 1, n), lambda b: F.when(b == 0, F.lit("\0")).otherwise(F.char(b))), "")
    return F.concat(F.regexp_extract(text(0, 8), "^([^ \0]*)", 1), F.lit("."), F.regexp_replace(text(8, 3), "\0", ""))


def entries(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """files(path, content) -> archive, kind, entry_idx, name, position, length, next_position, key; files that are no archive give an ``_error`` row."""
    count = little_endian(F.col(content), 8, 2)
    f = files.select(F.col(path).alias("archive"), F.col(content).alias("content"), count.alias("count"))
    size = F.octet_length("content")
    bad = F.when(F.substring("content", 1, 8) != F.lit(MAGIC), "invalid magic").when(F.col("count").isNull() | (size < 10 + F.col("count") * ENTRY), "table cut off").when(F.col("count") < 3, "no key: fewer than three members")
    f = f.withColumn("_error", F.when(F.octet_length("content") < 10, "too small").otherwise(bad))
    table = F.when(F.col("_error").isNull(), bytes_of(F.substring(F.col("content"), (size - F.col("count") * ENTRY + 1).cast("int"), (F.col("count") * ENTRY).cast("int"))))
    f = f.withColumn("table", table).withColumn("key", key_bytes(F.col("table"))).withColumn("table", unshift(F.col("table"), F.col("key")))
    at = F.col("entry_idx") * ENTRY
    rows = f.select("archive", "content", "count", "_error", "key", "table", F.explode_outer(F.when(F.col("_error").isNull(), F.sequence(F.lit(0), F.col("count").cast("int") - 1))).alias("entry_idx"))
    return rows.select("archive", archive_kind(F.col("count")).alias("kind"), "entry_idx", _name(F.col("table"), at).alias("name"), *[_number(F.col("table"), at + a, 4).alias(n) for a, n in ((12, "position"), (16, "length"), (20, "next_position"))], "key", "content", "_error")


def _unshifted(rows: pa.RecordBatch) -> pa.RecordBatch:
    data = [None if x is None else shifted(x, [-k for k in key]) for x, key in zip(rows.column("data").to_pylist(), rows.column("key").to_pylist(), strict=True)]
    names = ["archive", "entry_idx", "name", "data", "_error"]
    return pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if n == "data" else rows.column(n) for n in names], names)


def members(table: DataFrame) -> DataFrame:
    """Bytes of each member; a member that reaches beyond the file has an ``_error``."""
    fits = F.col("position") + F.col("length") <= F.octet_length("content")
    data = F.when(fits, F.substring(F.col("content"), (F.col("position") + 1).cast("int"), F.col("length").cast("int")))
    rows = table.select("archive", "entry_idx", "name", data.alias("data"), "key", F.coalesce("_error", F.when(~fits, "member cut off")).alias("_error"))
    return rows.mapInArrow(batch.in_passes(_unshifted, "data"), "archive string, entry_idx int, name string, data binary, _error string")


def find_member(table: DataFrame, name: str) -> DataFrame:
    """The first member of each archive with this name, in any case."""
    hit = table.where(F.lower("name") == name.lower())
    first = hit.groupBy("archive").agg(F.min("entry_idx").alias("entry_idx"))
    return hit.join(first, ["archive", "entry_idx"])


def safe_name(name: Column) -> Column:
    """A member's name as a file name: no folders, no leading dots."""
    return F.regexp_replace(F.regexp_replace(name, r"[/\\:\x00-\x1f]", "_"), r"^\.+", "_")


def build(items: list[tuple[str, bytes]], key: bytes) -> bytes:
    """An archive for tests and examples. Its layout gives the key away, as that of real archives does: the first member starts at byte 10, and each
    entry's next position is the position of the entry after it."""
    out = bytearray(MAGIC + len(items).to_bytes(2, "little"))
    table = bytearray()
    shift = lambda data: shifted(data, key)
    places = []
    for _, data in items:
        places.append(len(out))
        out += shift(data)
    for k, (name, data) in enumerate(items):
        stem, _, ext = name.partition(".")
        following = places[k + 1] if k + 1 < len(items) else len(out)
        table += stem.encode()[:8].ljust(8) + ext.encode()[:3].ljust(3, b"\0") + b"\0"
        table += b"".join(x.to_bytes(4, "little") for x in (places[k], len(data), following))
    return bytes(out + shift(table))

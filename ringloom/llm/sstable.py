"""Token ids as sorted-string tables.

A shard file holds documents in ascending order of their keys:

    block*  index  bloom  footer

A block is zstd over entries ``shared, rest, size`` (varints: bytes of the key shared with the entry before, further bytes of
the key, bytes of the value), key rest, value; its first entry shares nothing. The index has the first key, offset, length and
crc32 of each block. The Bloom filter holds the ids. The footer (fixed size, at the end) says where index and filter are, how
many documents and ids there are, how wide an id is, and ends in a magic word. A look-up asks the filter, finds the block by
binary search in the index and reads that block alone.

A key is a tag byte (0 for a null id, 1 else), the id as eight big-endian bytes with the sign flipped, and a four-byte number
among documents with this id.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm._common import bucket_of, key_ranges, n_parts, new_path
from ringloom.llm.tokens import default_tokenizer, task_encoder

MAGIC = b"RLSST001"
FOOTER = struct.Struct("<QQQQQQBB6x8s")
BLOCK = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7


def make_key(doc_id: int | None, number: int) -> bytes:
    return bytes([doc_id is not None]) + struct.pack(">QI", 0 if doc_id is None else doc_id + (1 << 63), number)


def split_key(key: bytes) -> tuple[int | None, int]:
    at, number = struct.unpack(">QI", key[1:])
    return (at - (1 << 63) if key[0] else None), number


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    first = np.fromiter((xxhash.xxh64_intdigest(x) for x in ids), np.uint64, len(ids))
    step = (first >> np.uint64(17)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (first[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


def _open(path: str, mode: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store.open_output_stream(at) if mode == "w" else store.open_input_file(at)


class Writer:
    """Documents must come in ascending order of their ids (null first)."""

    def __init__(self, path: str, width: int = 2):
        self.out, self.width, self.at = _open(path, "w"), width, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.block, self.size, self.last, self.first = [], 0, b"", b""
        self.ids: list[bytes] = []
        self.docs = self.tokens = self.number = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = make_key(doc_id, 0)
        if self.ids and self.ids[-1] == key[:9]:
            self.number += 1
            key = make_key(doc_id, self.number)
        else:
            self.number = 0
            self.ids.append(key[:9])
        value = ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.block:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=True)) if x != y), len(key))
        else:
            self.first = key
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.size += len(value) + 16
        self.last = key
        self.docs += 1
        self.tokens += len(ids)
        if self.size >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def _flush(self) -> None:
        if self.block:
            data = self.packer.compress(b"".join(self.block))
            self.index.append((self.first, self._put(data), len(data), zlib.crc32(data)))
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(key + struct.pack("<QQI", *rest) for key, *rest in self.index))
        bits = max(64, len(self.ids) * BLOOM_BITS + 7 & ~7)
        bloom = np.zeros(bits, bool)
        bloom[_bloom_places(np.array(self.ids, object), bits).ravel().astype(np.int64)] = True
        at = self._put(np.packbits(bloom, bitorder="little").tobytes())
        self._put(FOOTER.pack(index, len(self.index), at, bits, self.docs, self.tokens, self.width, 1, MAGIC))
        self.out.close()


class Reader:
    """Scan a shard in order, or look one id up."""

    def __init__(self, path: str):
        self.file = _open(path, "r")
        size = self.file.size()
        if size < FOOTER.size:
            raise ValueError(f"{path}: no footer")
        index, blocks, bloom, bits, self.docs, self.tokens, self.width, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: not such a file")
        raw, row = self.file.read_at(blocks * 33, index), struct.Struct("<13sQQI")
        self.index = [row.unpack_from(raw, 33 * i) for i in range(blocks)]
        self.firsts = [x[0] for x in self.index]
        self.bits, self.bloom = bits, np.unpackbits(np.frombuffer(self.file.read_at(bits // 8, bloom), np.uint8), bitorder="little")

    def _block(self, i: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        _, at, size, crc = self.index[i]
        data = self.file.read_at(size, at)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(data), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield *split_key(key), np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for doc_id, _, ids in self._block(i):
                yield doc_id, ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this id, in order; none if there is none."""
        key = make_key(doc_id, 0)
        if not self.bloom[_bloom_places(np.array([key[:9]], object), self.bits).ravel().astype(np.int64)].all():
            return []
        out = []
        for i in range(max(0, bisect.bisect_right(self.firsts, key) - 1), len(self.index)):
            if self.firsts[i][:9] > key[:9]:
                break
            out += [ids for d, _, ids in self._block(i) if d == doc_id]
        return out


def write_shards(docs: DataFrame, path: str, end_id: int | None = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Encode whole texts and write one file for each range of ids under ``path``.

    Returns a row for each file (shard, path, docs, tokens), in ascending order of the ids: as many as shuffle partitions at most.
    A file is valid once its row is returned; an attempt that is lost leaves a file that no row names.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts = key_ranges(rows, "id", n_parts(spark))
    rows = rows.withColumn("shard", bucket_of("id", cuts)).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("id", "text")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        with task_encoder(tokenizer) as code:
            for b in batches:
                for doc_id, text, shard in zip(*(b.column(i) for i in range(3)), strict=True):
                    if writer is None:
                        at, name = shard.as_py(), f"{path}/shard-{shard.as_py():06d}-{uuid.uuid4().hex[:12]}.sst"
                        writer = Writer(name, 2 if code.tokenizer.get_vocab_size() <= 1 << 16 else 4)
                    writer.add(doc_id.as_py(), np.frombuffer(code.encode(text.as_py()) + tail, "<u4"))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [at], "path": [name], "docs": [writer.docs], "tokens": [writer.tokens]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    _make_folder(path)
    return sorted(rows.mapInArrow(write, "shard int, path string, docs long, tokens long").collect())


def _make_folder(path: str) -> None:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.create_dir(at, recursive=True)


def read_shards(spark: SparkSession, files: list, id_col: str = "doc_id") -> DataFrame:
    """A row for each document of the files: id, start, n_tokens, ids_crc32 and shard, read in blocks."""
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long, shard int"
    if not files:
        return spark.createDataFrame([], schema)
    before = np.cumsum([0, *(f.tokens for f in files)]).tolist()
    work = spark.createDataFrame([(f.shard, f.path, s) for f, s in zip(files, before, strict=False)], "shard int, path string, start long")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, path, start in frame.itertuples(index=False):
                rows = []
                for doc_id, ids in Reader(path).scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _frame(rows, id_col)
                        rows = []
                yield _frame(rows, id_col)

    return work.repartition(len(files)).mapInPandas(read, schema)


def _frame(rows: list, id_col: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[id_col, "start", "n_tokens", "ids_crc32", "shard"]).astype({id_col: "Int64"})


def token_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards and describe every document as the files have it.

    Null and empty texts hold the end id alone. Documents with equal ids lie side by side, ordered by text; null ids come first.
    Very long texts are entries like others. Other columns are not read. No rows give no files and no rows.
    """
    path = path or new_path(docs.sparkSession, "sst")
    return read_shards(docs.sparkSession, write_shards(docs, path, **options), options.get("id_col", "doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))

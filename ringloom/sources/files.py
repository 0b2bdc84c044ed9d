"""Files as rows: scans, format detection, decoding, writing, reports. A bad file is a row with ``_error``, never an exception."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions.scalar import extension, file_stem, little_endian
from ringloom.sources import batch, images
from ringloom.sources.lzss import Truncated, expand, read_tokens



def new_folder(spark: SparkSession, name: str) -> str:
    """A path that doesn't exist yet in the shared folder of the session; one of our own is set only where the session has none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ringloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def of_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """Rows of one width; zero means all."""
    return df.where(F.col(column) == width) if width else df


FORMATS = {"lf2": "LF2", "pdt": "PDT", "pak": "PAK", "scn": "SCN", "g00": "G00"}


_SCAN = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("format", pa.string())])
#: Bytes of files that a scan hands on at once, about.
SCANNED = 4 << 20


def _store(path: str):
    """File system and path in it. A local path is taken as it is written, as Spark does; any other is a URI that pyarrow knows."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def _listed(root: str, recursive: bool) -> Iterator[str]:
    """Files of a folder, or the file itself; names that begin with a dot or an underscore are hidden, as in Spark. A local folder is never held whole."""
    from pyarrow import fs

    store, at = _store(root)
    if store.get_file_info(at).type == fs.FileType.File:
        yield at
    elif isinstance(store, fs.LocalFileSystem):
        todo = [at]
        while todo:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    if e.name[0] in "._":
                        continue
                    if not e.is_dir():
                        yield e.path
                    elif recursive:
                        todo.append(e.path)
    else:
        todo = [at]
        while todo:
            for x in store.get_file_info(fs.FileSelector(todo.pop())):
                if x.base_name[0] not in "._":
                    if x.type == fs.FileType.File:
                        yield x.path
                    elif recursive:
                        todo.append(x.path)


def scan(spark: SparkSession, *paths: str, kinds: tuple[str, ...] = tuple(FORMATS), recursive: bool = False) -> DataFrame:
    """Files or one level of folders: path, length, content, format. Extensions count in any case; order is left to the output.

    Folders are listed in tasks and their files are dealt out by path to the tasks that read them, so the driver holds no list of files. Any store that
    pyarrow knows.
    """

    def heads(root: str) -> tuple:
        """File system, its own path of the root, and the root as it is shown."""
        store, at = _store(root)
        local = "://" not in root or root.startswith("file:")
        return store, at.rstrip("/"), f"file:{at.rstrip('/')}" if local else root.rstrip("/")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root in b.column("root").to_pylist():
                _, own, shown = heads(root)
                found = _listed(root, recursive)
                while some := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([root] * len(some), pa.string()), pa.array([shown + x[len(own) :] for x in some], pa.string())], ["root", "path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            rows, held = [], 0
            for i, (root, path, kind) in enumerate(zip(*(b.column(c).to_pylist() for c in ("root", "path", "format")), strict=True)):
                store, own, shown = known[root] = known.get(root) or heads(root)
                with store.open_input_stream(own + path[len(shown) :], compression=None) as f:
                    content = f.read()
                rows.append((path, len(content), content, kind))
                held += len(content)
                if held >= SCANNED or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCAN.types, strict=True)], schema=_SCAN)
                    rows, held = [], 0

    roots = spark.createDataFrame([(p,) for p in paths], "root string").mapInArrow(listed, "root string, path string")
    path = F.col("path")
    wanted = roots.withColumn("format", format_by_extension(path)).where(extension(path).isin(*kinds))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return wanted.repartition(parts, "path").mapInArrow(read, "path string, length long, content binary, format string")


def format_by_extension(path: Column) -> Column:
    ext = extension(path)
    out = F.lit(None).cast("string")
    for e, name in FORMATS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def format_by_magic(content: Column) -> Column:
    head = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    return F.when(head(b"LEAF256"), "LF2").when(head(b"PDT10"), "PDT").when(head(b"LEAFPACK"), "PAK")


def detect(files: DataFrame) -> DataFrame:
    """The magic word decides, then the extension."""
    found = F.coalesce(format_by_magic(F.col("content")), format_by_extension(F.col("path")))
    return files.withColumn("format", found).withColumn("_error", F.when(found.isNull(), "unknown format").when(found == "G00", "unsupported"))


def lf2_headers(files: DataFrame) -> DataFrame:
    """Header fields in column expressions; short or foreign files have nulls and an ``_error``."""
    c = F.col("content")
    ok = (F.octet_length(c) >= 24) & (F.substring(c, 1, 8) == F.lit(images.LF2_MAGIC))
    fields = {"x_offset": (8, 2), "y_offset": (10, 2), "width": (12, 2), "height": (14, 2), "transparent_color": (0x12, 1), "color_count": (0x16, 1)}
    out = files.select("path", *[F.when(ok, little_endian(c, at, n)).cast("int").alias(name) for name, (at, n) in fields.items()], F.when(~ok, "no LF2 header").alias("_error"))
    return out.withColumn("payload_start", F.col("color_count") * 3 + 24)


DECODED = "path string, format string, width int, height int, transparent int, palette array<struct<r:int,g:int,b:int>>, pixels binary, alpha binary, decode_ms double, _error string"
_RGB = pa.list_(pa.struct([("r", pa.int32()), ("g", pa.int32()), ("b", pa.int32())]))
DECODED_TYPES = pa.schema([("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("transparent", pa.int32()), ("palette", _RGB), ("pixels", pa.binary()), ("alpha", pa.binary()), ("decode_ms", pa.float64()), ("_error", pa.string())])
#: Bytes of files that are decoded or written at once, so that their arrays stay in a core's cache.
STRETCH = 1 << 17


def decode(files: DataFrame) -> DataFrame:
    """LF2, SCN (an LF2 by another name) and PDT files to image rows."""

    names = [x.name for x in DECODED_TYPES]

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        began = time.perf_counter()
        kinds, contents = rows.column("format").to_pylist(), rows.column("content").to_pylist()
        found = images.read_all(contents, kinds)
        spent = (time.perf_counter() - began) * 1e3 / max(1, sum(map(len, contents)))  # a file's share of its stretch by its size
        out, palettes = [], {}
        for path, kind, content, x in zip(rows.column("path").to_pylist(), kinds, contents, found, strict=True):
            if isinstance(x, Exception):
                out.append((path, kind, None, None, None, None, None, None, None, str(x)))
            else:
                palette = palettes.setdefault(tuple(x.palette), len(palettes))
                out.append((path, kind, x.width, x.height, x.transparent, palette, x.pixels, x.alpha, spent * len(content), None))
        columns = dict(zip(names, zip(*out, strict=True), strict=True))
        few = pa.array([[{"r": r, "g": g, "b": b} for r, g, b in p] for p in palettes], _RGB)  # files often have the same one
        return pa.RecordBatch.from_arrays([few.take(pa.array(c, pa.int32())) if n == "palette" else pa.array(c, DECODED_TYPES.field(n).type) for n, c in columns.items()], names)

    return files.select("path", "content", "format").mapInArrow(batch.in_passes(make, most=STRETCH), DECODED)


TOKENS = "file string, token_idx int, is_match boolean, lit int, pos int, len int, len_eff int, input_pos int, _error string"


def tokens(files: DataFrame) -> DataFrame:
    """A row for each token of LF2 payloads, with the cursor before it and the length that is left of the image; cut-off payloads end in an ``_error``
    row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TOKENS.split(", ")]
        kinds = {n: "Int32" for n in ("token_idx", "lit", "pos", "len", "len_eff", "input_pos")} | {"is_match": "boolean"}
        for frame in frames:
            for path, content in frame[["path", "content"]].itertuples(index=False):
                rows, at, i = [], 0, 0
                try:
                    h = images.lf2_header(content)
                    total = h["width"] * h["height"]
                    for i, t in enumerate(read_tokens(content[h["payload_start"] :], total, strict=True)):
                        left = min(t.len, total - at)
                        rows.append((path, i, t.is_match, t.lit, t.pos, t.len, left, at, None))
                        at += left
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=names).astype(kinds)
                            rows = []
                except (ValueError, IndexError, Truncated) as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=names).astype(kinds)

    return files.select("path", "content").mapInPandas(run, TOKENS)


def ring_input(content: bytes) -> bytes:
    """The bytes that went through the ring: the image's rows in the file's order."""
    h = images.lf2_header(content)
    total = h["width"] * h["height"]
    return expand(read_tokens(content[h["payload_start"] :], total, strict=True), total)


def outputs(decoded: DataFrame, kind: str = "bmp") -> DataFrame:
    """path, name (with the new extension) and bytes of each decoded image."""

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, seen = [], {}
        colours = np.stack([rows.column("palette").flatten().field(c).to_numpy(zero_copy_only=False) for c in "rgb"], 1).astype(np.uint8)
        ends = np.cumsum(rows.column("palette").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        for r, end in zip(rows.drop_columns("palette").to_pylist(), ends.tolist(), strict=True):
            raw, begin = colours[begin:end].tobytes(), end
            palette = seen[raw] = seen[raw] if raw in seen else [tuple(raw[i : i + 3]) for i in range(0, len(raw), 3)]
            x = images.Image("pdt" if r["format"] == "PDT" else "lf2", r["width"], r["height"], r["pixels"], palette, r["transparent"], alpha=r["alpha"])
            data.append(images.encode_as(x, kind))
        return pa.RecordBatch.from_arrays([rows.column("path"), pa.array(data, pa.binary())], ["path", "data"])

    made = decoded.where("_error is null").drop("decode_ms", "_error").mapInArrow(batch.in_passes(make, "pixels", STRETCH), "path string, data binary")
    return made.select("path", F.concat(file_stem(F.col("path")), F.lit(f".{kind}")).alias("name"), "data")


def write_outputs(made: DataFrame, folder: str) -> None:
    """Write each output under its name; any store that pyarrow knows."""

    def put(rows: Iterator) -> None:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{at}/{r['name']}") as out:
                out.write(bytes(r["data"]))

    made.select("name", "data").foreachPartition(put)


def report(files: DataFrame, decoded: DataFrame) -> DataFrame:
    """Size, time, memory and transparency of each image. memory_kb counts four bytes a pixel."""
    text = F.decode("pixels", "ISO-8859-1")  # a character for each byte
    clear = F.length(text) - F.length(F.replace(text, F.char("transparent"), F.lit("")))
    raw = F.col("width").cast("long") * F.col("height") * F.when(F.col("format") == "PDT", 3).otherwise(1)
    # pixels are counted before the join, so that they aren't shuffled
    counted = decoded.select("path", "width", "height", "format", "decode_ms", clear.alias("clear"), "_error")
    both = counted.join(files.select("path", F.col("length").alias("size")), "path")
    return both.select(F.col("path").alias("file"), "size", "width", "height", "format", F.col("decode_ms").alias("decode_time_ms"), F.expr("width * cast(height as bigint) * 4 div 1024").alias("memory_kb"), F.when(F.col("size") == 0, 0.0).otherwise(raw / F.col("size")).alias("compression_ratio"), F.when(F.col("format") != "PDT", F.col("clear")).alias("transparent_pixels"), "_error")

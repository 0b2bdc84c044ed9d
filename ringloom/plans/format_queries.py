"""Queries that write and read files of every format, held against SQL by digests of their bytes.

Documents stand in for the files' contents. Digests are md5 over the upper-case hex text of bytes, which both engines can build.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.operators import aggregates, encoders, features
from ringloom.plans.codec_queries import image_files, text_files
from ringloom.plans.registry import query, table
from ringloom.sources import archive, batch, datasets, files, images
from ringloom.streaming import resume

_BYTES = "encode(coalesce(text, ''))"
#: Hex text of a document's bytes, filled up with blanks to rows of 16 bytes; its rows from the last to the first are the LF2 image.
_H = f"rpad(hex({_BYTES}), CAST(32 * ((octet_length({_BYTES}) + 15) // 16) AS INT), '20')"
_IMAGE = f"array_to_string(list_reverse(regexp_extract_all({_H}, '.{{32}}')), '')"
#: The same in rows of 16 RGB pixels, for PDT; those of even ids have an alpha mask, which repeats the red bytes.
_H3 = f"rpad(hex({_BYTES}), CAST(96 * ((octet_length({_BYTES}) + 47) // 48) AS INT), '20')"
_ALPHA = "CASE WHEN doc_id % 2 = 0 THEN p[1:2] ELSE 'FF' END"


def _le32(x: str) -> str:
    return f"format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', ({x}) % 256, ({x}) // 256 % 256, ({x}) // 65536 % 256, ({x}) // 16777216)"


def _digest(c: str) -> Column:
    return F.md5(F.hex(c))


def _lf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.decode(image_files(spark, sf_dir)).where("_error is null")


@query("pixel_digest", f"SELECT doc_id || '.lf2' AS file, md5({_IMAGE}) AS pixels_md5 FROM documents")
def pixel_digest(spark, sf_dir):
    """Every pixel of every LF2 image, rows in the image's order."""
    return _lf2(spark, sf_dir).select(F.col("path").alias("file"), _digest("pixels").alias("pixels_md5"))


def _mapped(expr: str, of: str = _IMAGE, size: int = 2) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({of}, '.{{{size}}}'), lambda p: {expr}), '')"


def _sink(spark: SparkSession, decoded: DataFrame, kind: str) -> DataFrame:
    return files.outputs(decoded, kind).select("name", F.octet_length("data").cast("long").alias("size"), _digest("data").alias("md5"))


_PIXELS = f"CAST(16 * ((octet_length({_BYTES}) + 15) // 16) AS BIGINT)"


@query("sink_raw", f"SELECT doc_id || '.raw' AS name, 3 * {_PIXELS} AS size, md5({_mapped("CASE WHEN p = '20' OR p >= '80' THEN '000000' ELSE p || p || p END")}) AS md5 FROM documents")
def sink_raw(spark, sf_dir):
    """RGB bytes; clear pixels are black."""
    return _sink(spark, _lf2(spark, sf_dir), "raw")


@query("sink_rgba", f"SELECT doc_id || '.rgba' AS name, 4 * {_PIXELS} AS size, md5({_mapped("CASE WHEN p >= '80' THEN '00000000' ELSE p || p || p || (CASE WHEN p = '20' THEN '00' ELSE 'FF' END) END")}) AS md5 FROM documents")
def sink_rgba(spark, sf_dir):
    return _sink(spark, _lf2(spark, sf_dir), "rgba")


_BMP8 = f"'424D' || {_le32(f'1078 + {_PIXELS}')} || '0000000036040000' || '28000000' || '10000000' || {_le32(f'{_PIXELS} // 16')} || '0100080000000000' || {_le32(_PIXELS)} || '130B0000130B0000' || '0001000000000000'"
_GREYS = "array_to_string(list_transform(range(256), lambda i: CASE WHEN i < 128 THEN format('{0:02X}{0:02X}{0:02X}00', i) ELSE '00000000' END), '')"


@query("sink_bmp8", f"SELECT doc_id || '.bmp' AS name, 1078 + {_PIXELS} AS size, md5({_BMP8} || {_GREYS} || {_H}) AS md5 FROM documents")
def sink_bmp8(spark, sf_dir):
    """Eight bits a pixel, a full palette, rows from the bottom."""
    return _sink(spark, _lf2(spark, sf_dir), "bmp")


def _unpng(rows: pa.RecordBatch) -> pa.RecordBatch:
    found = [images.read_png(x) for x in rows.column("data").to_pylist()]
    width, height, data = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([rows.column("name"), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(data, pa.binary())], ["name", "width", "height", "data"])


@query("sink_png", f"SELECT doc_id || '.png' AS name, 16 AS width, CAST({_PIXELS} // 16 AS INT) AS height, md5({_mapped("CASE WHEN p >= '80' THEN '00000000' ELSE p || p || p || (CASE WHEN p = '20' THEN '00' ELSE 'FF' END) END")}) AS md5 FROM documents")
def sink_png(spark, sf_dir):
    """Chunks with their checksums, and the pixels that a PNG reader finds."""
    made = files.outputs(_lf2(spark, sf_dir), "png").select("name", "data")
    return made.mapInArrow(batch.in_passes(_unpng, "data", files.STRETCH), "name string, width int, height int, data binary").select("name", "width", "height", _digest("data").alias("md5"))


def pdt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for path, data in zip(rows.column("path").to_pylist(), rows.column("content").to_pylist(), strict=True):
            data += b" " * (-len(data) % 48)
            alpha = data[::3] if path and int(path[:-4]) % 2 == 0 else b""
            made.append(images.write_pdt(images.Image("pdt", 16, len(data) // 48, data, alpha=alpha)))
        return pa.RecordBatch.from_arrays([rows.column("path"), pa.array(made, pa.binary())], ["path", "content"])

    named = text_files(spark, sf_dir).select(F.concat("file", F.lit(".pdt")).alias("path"), "content")
    return named.mapInArrow(batch.in_passes(make, most=files.STRETCH), "path string, content binary").withColumn("format", F.lit("PDT"))


_PIXELS3 = f"CAST(16 * ((octet_length({_BYTES}) + 47) // 48) AS BIGINT)"


@query("pdt_inflate", f"SELECT doc_id || '.pdt' AS file, 16 AS width, CAST({_PIXELS3} // 16 AS INT) AS height, md5({_H3}) AS pixels_md5, md5({_mapped(_ALPHA, _H3, 6)}) AS alpha_md5 FROM documents")
def pdt_inflate(spark, sf_dir):
    """Colours and mask of PDT files, with and without a mask stream."""
    d = files.decode(pdt_files(spark, sf_dir)).where("_error is null")
    return d.select(F.col("path").alias("file"), "width", "height", _digest("pixels").alias("pixels_md5"), _digest("alpha").alias("alpha_md5"))


@query("pdt_sink_raw", f"SELECT doc_id || '.raw' AS name, 3 * {_PIXELS3} AS size, md5({_H3}) AS md5 FROM documents")
def pdt_sink_raw(spark, sf_dir):
    return _sink(spark, files.decode(pdt_files(spark, sf_dir)), "raw")


@query("pdt_sink_rgba", f"SELECT doc_id || '.rgba' AS name, 4 * {_PIXELS3} AS size, md5({_mapped(f'p || {_ALPHA}', _H3, 6)}) AS md5 FROM documents")
def pdt_sink_rgba(spark, sf_dir):
    return _sink(spark, files.decode(pdt_files(spark, sf_dir)), "rgba")


_BMP32 = f"'424D' || {_le32(f'54 + 4 * {_PIXELS3}')} || '0000000036000000' || '28000000' || '10000000' || {_le32(f'{_PIXELS3} // 16')} || '0100200000000000' || {_le32(f'4 * {_PIXELS3}')} || '130B0000130B0000' || '0000000000000000'"
_UPWARD = f"array_to_string(list_reverse(regexp_extract_all({_H3}, '.{{96}}')), '')"


@query("pdt_sink_bmp32", f"SELECT doc_id || '.bmp' AS name, 54 + 4 * {_PIXELS3} AS size, md5({_BMP32} || {_mapped(f'p[5:6] || p[3:4] || p[1:2] || {_ALPHA}', _UPWARD, 6)}) AS md5 FROM documents")
def pdt_sink_bmp32(spark, sf_dir):
    return _sink(spark, files.decode(pdt_files(spark, sf_dir)), "bmp")


@query("image_report", f"SELECT doc_id || '.lf2' AS file, 16 AS width, CAST({_PIXELS} // 16 AS INT) AS height, {_PIXELS} * 4 // 1024 AS memory_kb, CAST(len(list_filter(regexp_extract_all({_H}, '..'), lambda p: p = '20')) AS INT) AS transparent_pixels FROM documents")
def image_report(spark, sf_dir):
    """Memory and clear pixels of each image."""
    f = image_files(spark, sf_dir)
    return files.report(f, files.decode(f)).where("_error is null").select("file", "width", "height", F.col("memory_kb").cast("long").alias("memory_kb"), "transparent_pixels")


@query(
    "palette_of_colours",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all({_H3}, '.{{6}}') AS c FROM documents),
    u AS (SELECT doc_id, unnest(c) AS colour, generate_subscripts(c, 1) AS i FROM t), f AS (SELECT doc_id, colour, min(i) AS i FROM u GROUP BY ALL)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS colours, md5(string_agg(colour, '' ORDER BY i)) AS palette_md5 FROM f GROUP BY doc_id""",
)
def palette_of_colours(spark, sf_dir):
    """Distinct colours of each image in order of appearance, and pixels that point back at them."""

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for file, data in zip(rows.column("file").to_pylist(), rows.column("content").to_pylist(), strict=True):
            data += b" " * (-len(data) % 48)
            colours, which = images.colours_of(data)
            if colours[which].tobytes() != data:
                raise ValueError(f"{file}: pixels don't point at their colours")
            if len(colours) <= 256:
                palette, index = images.quantise(data, 256)
                if palette != [tuple(c) for c in colours.tolist()] or index != which.astype(np.uint8).tobytes():
                    raise ValueError(f"{file}: pixels don't point at their colours")
            if len(colours):
                made.append((None if file is None else int(file), len(colours), colours.tobytes()))
        columns = zip(*made, strict=True) if made else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "colours", "data"])

    palettes = text_files(spark, sf_dir).mapInArrow(batch.in_passes(make, most=files.STRETCH), "doc_id long, colours long, data binary")
    return palettes.select("doc_id", "colours", _digest("data").alias("palette_md5"))


_KINDS = "['lf2', 'PDT', 'pak', 'scn', 'g00', 'txt']"


def _mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, ("lf2", "PDT", "pak", "scn", "g00", "txt"))), F.pmod(F.col("file").cast("long"), F.lit(6)).cast("int"))
    return text_files(spark, sf_dir).select(F.concat("file", F.lit("."), ext).alias("name"), F.col("content").alias("data"))


@query("directory_scan", f"SELECT doc_id || '.' || {_KINDS}[doc_id % 6 + 1] AS name, ['LF2', 'PDT', 'PAK', 'SCN', 'G00'][doc_id % 6 + 1] AS format, CAST(octet_length({_BYTES}) AS BIGINT) AS length, md5(hex({_BYTES})) AS md5 FROM documents WHERE doc_id % 6 < 5")
def directory_scan(spark, sf_dir):
    """A folder that the sink wrote, read back by extension in any case; other files are left out."""
    folder = files.new_folder(spark, "scan")
    files.write_outputs(_mixed_files(spark, sf_dir), folder)
    return files.scan(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), "format", "length", _digest("content").alias("md5"))


@query(
    "format_detect",
    f"""SELECT doc_id || '.' || {_KINDS}[doc_id % 6 + 1] AS path, CASE doc_id % 4 WHEN 0 THEN 'LF2' WHEN 1 THEN 'PDT' WHEN 2 THEN 'PAK' ELSE ['LF2', 'PDT', 'PAK', 'SCN', 'G00'][doc_id % 6 + 1] END AS format,
    CASE WHEN doc_id % 4 < 3 THEN NULL WHEN doc_id % 6 = 5 THEN 'unknown format' WHEN doc_id % 6 = 4 THEN 'unsupported' END AS _error FROM documents""",
)
def format_detect(spark, sf_dir):
    """The magic word goes before the extension; unsupported and unknown files are rows with an error."""
    head = F.get(F.array(*(F.lit(m) for m in (images.LF2_MAGIC, images.PDT_MAGIC, archive.MAGIC, b"?"))), F.pmod(F.substring_index("name", ".", 1).cast("long"), F.lit(4)).cast("int"))
    made = _mixed_files(spark, sf_dir).select(F.col("name").alias("path"), F.concat(head, "data").alias("content"))
    return files.detect(made).select("path", "format", "_error")


def pak_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each eight documents."""

    def made(n: int | None, items: list[tuple[str, bytes]]) -> tuple[str | None, bytes]:
        key = bytes(((n or 0) * 7 + 31 * i) & 0xFF for i in range(archive.KEY))
        return None if n is None else f"{n}.pak", archive.build(items, key)

    def rows_of(done: list[tuple[str | None, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.binary())], ["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # documents come in order, so that one archive's are held, and the archives of a stretch
        last, items, done = None, [], []
        for b in batch.passes(batches, "content"):
            for n, file, content in zip(*(b.column(c).to_pylist() for c in ("n", "file", "content")), strict=True):
                if n != last:
                    if len(items) >= 3:
                        done.append(made(last, items))
                    items = []
                last = n
                items.append((f"{file}.TXT", content))
            yield rows_of(done)
            done = []
        yield rows_of([made(last, items)] if len(items) >= 3 else [])

    id = F.col("file").cast("long")
    rows = text_files(spark, sf_dir).select(F.expr("cast(file as long) div 8").alias("n"), id.alias("file"), "content")
    return rows.repartition("n").sortWithinPartitions("n", "file", "content").mapInArrow(run, "path string, content binary")


_MEMBERS = f"(SELECT *, doc_id // 8 AS n, CAST(octet_length({_BYTES}) AS BIGINT) AS size, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id // 8) AS k FROM documents)"


@query(
    "pak_entries",
    f"""SELECT n || '.pak' AS archive, 'Unknown' AS kind, CAST(i AS INT) AS entry_idx, doc_id || '.TXT' AS name, CAST(10 + sum(size) OVER w - size AS BIGINT) AS position, size AS length, CAST(10 + sum(size) OVER w AS BIGINT) AS next_position
    FROM {_MEMBERS} WHERE k >= 3 WINDOW w AS (PARTITION BY n ORDER BY i)""",
)
def pak_entries(spark, sf_dir):
    """Key and table of each archive, from its bytes alone."""
    return archive.entries(pak_files(spark, sf_dir)).select("archive", "kind", "entry_idx", "name", "position", "length", "next_position")


@query("pak_members", f"SELECT n || '.pak' AS archive, CAST(i AS INT) AS entry_idx, doc_id || '.TXT' AS name, md5(hex({_BYTES})) AS md5 FROM {_MEMBERS} WHERE k >= 3")
def pak_members(spark, sf_dir):
    """The bytes of every member."""
    return archive.members(archive.entries(pak_files(spark, sf_dir))).where("_error is null").select("archive", "entry_idx", "name", _digest("data").alias("md5"))


@query("pak_find_member", f"SELECT n || '.pak' AS archive, CAST(i AS INT) AS entry_idx, doc_id || '.TXT' AS name, size AS length FROM {_MEMBERS} WHERE k >= 3 AND doc_id = 17")
def pak_find_member(spark, sf_dir):
    """One member by its name, in any case."""
    return archive.find_member(archive.entries(pak_files(spark, sf_dir)), "17.txt").select("archive", "entry_idx", "name", "length")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("f"), "o_orderkey").alias("file"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") > 200_000).alias("match"), F.col("o_custkey").alias("tokens"), F.length("o_orderpriority").cast("long").alias("multi"), F.round("o_totalprice", 2).alias("elapsed_s"))


_RESULTS = "(SELECT 'f' || o_orderkey AS file, nullif(o_orderstatus, 'P') AS status, o_totalprice > 200000 AS match, o_custkey AS tokens, CAST(length(o_orderpriority) AS BIGINT) AS multi, round(o_totalprice, 2) AS elapsed_s FROM orders)"


@query("csv_sink_and_scan", f"SELECT * FROM {_RESULTS} r")
def csv_sink_and_scan(spark, sf_dir):
    """A dataset written as CSV and read by its schema; the sentinel for nulls comes and goes."""
    folder = files.new_folder(spark, "csv")
    datasets.write(_results(spark, sf_dir), "batch_results", folder)
    return datasets.read(spark, "batch_results", folder)


@query("csv_lazy_filter", f"SELECT status, count(*) AS n, sum(tokens) AS tokens FROM {_RESULTS} r WHERE match AND tokens % 3 = 1 GROUP BY status")
def csv_lazy_filter(spark, sf_dir):
    folder = files.new_folder(spark, "csv")
    datasets.write(_results(spark, sf_dir), "batch_results", folder)
    return datasets.read(spark, "batch_results", folder).where("match and tokens % 3 = 1").groupBy("status").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("tsv_hex_and_lists", "SELECT 'f' || l_orderkey AS file, l_linenumber AS token_idx, l_partkey AS ring_r, CAST(l_quantity AS BIGINT) + l_suppkey AS dists_sum, 2 AS n_dists FROM lineitem")
def tsv_hex_and_lists(spark, sf_dir):
    """Tab-separated rows with a column of hex text and one of joined numbers."""
    t = table(spark, sf_dir, "lineitem")
    zero = F.lit(0)
    made = t.select(F.concat(F.lit("f"), "l_orderkey").alias("file"), F.col("l_linenumber").alias("token_idx"), F.lower(F.hex("l_partkey")).alias("ring_r"), zero.alias("leaf_pos"), zero.alias("leaf_dist"), zero.alias("max_len"), zero.alias("n_max"), F.concat_ws(",", F.col("l_quantity").cast("long"), "l_suppkey").alias("dists_csv"), zero.alias("leaf_dist_rank"))
    folder = files.new_folder(spark, "tsv")
    datasets.write(made, "tiebreaks", folder)
    got = datasets.with_lists(datasets.with_hex(datasets.read(spark, "tiebreaks", folder), "ring_r"), "dists_csv", ",")
    return got.select("file", "token_idx", F.col("ring_r").cast("long").alias("ring_r"), F.aggregate("dists_csv", F.lit(0).cast("long"), lambda a, x: a + x).alias("dists_sum"), F.size("dists_csv").alias("n_dists"))


@query("json_sink_and_load", "SELECT r_name AS region, n_name AS nation, n_nationkey AS key FROM region JOIN nation ON n_regionkey = r_regionkey")
def json_sink_and_load(spark, sf_dir):
    """One JSON document with nested lists, written and loaded whole."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = n.groupBy("r_name").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("nations"))
    whole = by.agg(F.collect_list(F.struct("r_name", "nations")).alias("regions"))  # five regions
    folder = files.new_folder(spark, "json")
    datasets.write_json(whole, folder)
    got = datasets.json_document(spark, folder).select(F.explode("regions").alias("r")).select("r.r_name", F.explode("r.nations").alias("n"))
    return got.select(F.col("r_name").alias("region"), F.col("n.n_name").alias("nation"), F.col("n.n_nationkey").cast("int").alias("key"))


@query("file_list_source", "SELECT c_name AS file FROM customer WHERE c_custkey % 5 = 0")
def file_list_source(spark, sf_dir):
    """One name a line; blank lines don't count."""
    folder = files.new_folder(spark, "list")
    c = table(spark, sf_dir, "customer")
    c.select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("  "), "c_name")).otherwise(" ").alias("value")).write.text(folder)
    return datasets.file_list(spark, folder)


_WORKED = "SELECT c_custkey AS key, upper(c_name) AS done, c_custkey % 2 = 1 AS second FROM customer"


@query("resume_batches", _WORKED)
def resume_batches(spark, sf_dir):
    """A batch over half of the keys, then one over all: what is done isn't done again."""
    todo, folder = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name"), files.new_folder(spark, "resume")
    work = lambda second: lambda left: left.select("key", F.upper("c_name").alias("done"), F.lit(second).alias("second"))
    resume.run_remaining(todo.where("key % 2 = 0"), work(False), folder, ["key"])
    resume.run_remaining(todo, work(True), folder, ["key"])
    return spark.read.parquet(folder)


@query("resume_stream", "SELECT c_custkey AS key, upper(c_name) AS done FROM customer")
def resume_stream(spark, sf_dir):
    """The same as a stream of files that ends when all are read; a batch before it has done a third."""
    todo, folder = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name"), files.new_folder(spark, "resume")
    work = lambda left: left.select("key", F.upper("c_name").alias("done"))
    resume.run_remaining(todo.where("key % 3 = 0"), work, folder, ["key"])
    source = files.new_folder(spark, "source")
    todo.write.parquet(source)
    stream = spark.readStream.schema(todo.schema).parquet(source)
    resume.stream_remaining(stream, work, folder, ["key"], files.new_folder(spark, "stream")).awaitTermination()
    return spark.read.parquet(folder)


@query("variant_coverage", "WITH g AS (SELECT DISTINCT o_custkey AS file, o_orderpriority AS variant FROM orders WHERE o_orderstatus = 'F'), k AS (SELECT file, count(*) AS k FROM g GROUP BY file) SELECT variant, count(*) AS files, count(*) FILTER (k = 1) AS alone FROM g JOIN k USING (file) GROUP BY variant")
def variant_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return encoders.coverage(o.select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("variant"), (F.col("o_orderstatus") == "F").alias("exact")))


@query("uncovered_files", "SELECT DISTINCT o_custkey AS file FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def uncovered_files(spark, sf_dir):
    """Files that no variant reproduces."""
    o = table(spark, sf_dir, "orders")
    return encoders.uncovered(o.select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("variant"), (F.col("o_orderstatus") == "F").alias("exact")))


@query(
    "offset_heatmap",
    """WITH t AS (SELECT 1 + l_orderkey % 640 AS img_w, l_partkey AS d FROM lineitem WHERE l_linenumber = 1),
    u AS (SELECT img_w, d // img_w + CASE WHEN d % img_w > img_w // 2 THEN 1 ELSE 0 END AS r, d % img_w - CASE WHEN d % img_w > img_w // 2 THEN img_w ELSE 0 END AS c FROM t)
    SELECT img_w, CAST(least(greatest(r, 0), 16) AS INT) AS row, CAST(least(greatest(c, -16), 16) AS INT) AS col, count(*) AS n FROM u GROUP BY ALL""",
)
def offset_heatmap(spark, sf_dir):
    """Row and column offsets of chosen candidates by image width, clamped."""
    t = table(spark, sf_dir, "lineitem")
    ties = t.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") == 1).cast("int").alias("is_leaf"), F.col("l_partkey").alias("cand_dist"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (1 + F.col("o_orderkey") % 640).alias("img_w"))
    return features.offset_heat(ties, o)


@query("first_appearance_sizes", "WITH g AS (SELECT user_id, event_type, count(*) AS size, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, event_type, size, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS INT) AS place FROM g")
def first_appearance_sizes(spark, sf_dir):
    """Sizes of groups in the order in which the groups appear."""
    return aggregates.appearance_sizes(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("width_filter", "SELECT p_size AS wanted, p_partkey FROM part WHERE p_size IN (7, 16) UNION ALL SELECT 0, p_partkey FROM part")
def width_filter(spark, sf_dir):
    """Rows of one width; zero means all."""
    p = table(spark, sf_dir, "part")
    some = [files.of_width(p, "p_size", w).select(F.lit(w).alias("wanted"), "p_partkey") for w in (7, 16, 0)]
    return some[0].union(some[1]).union(some[2])


@query(
    "map_kernel",
    """WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, CAST(count(*) AS INT) AS kinds, CAST(count(*) FILTER (n > 1) AS INT) AS repeated, max(n) FILTER (event_type = 'click') AS clicks, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS listed FROM g GROUP BY user_id""",
)
def map_kernel(spark, sf_dir):
    """Counts in a map: look-up, filter on values, entries in order."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    m = g.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))
    listed = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("user_id", F.size("m").alias("kinds"), F.size(F.map_filter("m", lambda _, v: v > 1)).alias("repeated"), F.try_element_at("m", F.lit("click")).alias("clicks"), listed.alias("listed"))

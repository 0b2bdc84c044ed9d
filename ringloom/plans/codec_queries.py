"""Queries over the codecs. Documents stand in for image files: the bytes of a whole text are the pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.operators import by_file, encoders
from ringloom.plans.registry import query, table
from ringloom.sources.files import new_folder


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("file"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


@query("lzss_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS file, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, TRUE AS decodable FROM documents")
def lzss_roundtrip(spark, sf_dir):
    """Every whole text survives encoding and decoding."""
    files = text_files(spark, sf_dir)
    out = encoders.encoded_files(files.select(F.concat("file", F.lit(":"), F.octet_length("content")).alias("file"), "content"), ["chain3_8_first"])
    return out.select(F.substring_index("file", ":", 1).alias("file"), "decodable", F.substring_index("file", ":", -1).cast("long").alias("size"))


@query("lzss_sizes")
def lzss_sizes(spark, sf_dir):
    """Tokens and packed bytes of every text under the hash-chain variants."""
    return encoders.encoded_files(text_files(spark, sf_dir), ["chain3_8_first", "chain3_8_last"]).select("file", "variant", "tokens", "bytes", "decodable")


WIDTH = 16
TRUTH = "chain3_8_first"
RIVALS = ["chain3_8_last", "chain8_first", "chain_oldest8"]


#: Tables that a session has written, by application, folder of the inputs and name.
_KEPT: dict[tuple[str, str, str], tuple[str, object]] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that encodes or decodes every text is written once in the shared folder, and read by all queries of the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        df, path = make(), new_folder(spark, name)
        df.write.parquet(path)
        _KEPT[key] = (path, df.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An LF2 file for each document: its bytes, filled up to whole rows, packed by the variant that counts as the truth."""
    return _kept(spark, sf_dir, "lf2", lambda: _encoded_images(spark, sf_dir))


def _encoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    from ringloom.sources import batch
    from ringloom.sources.images import Image, lf2_head

    def make(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = batch.filled(*batch.bytes_column(rows.column("content")), WIDTH)
        payload, at = batch.frame(encoders.tokens_of(data, bounds, TRUTH))
        raw, grey = payload.tobytes(), [(i, i, i) for i in range(128)]
        content = [lf2_head(Image("lf2", WIDTH, n // WIDTH, b"", grey, 32)) + raw[s:e] for n, s, e in zip((bounds[1:] - bounds[:-1]).tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([rows.column("path"), pa.array(content, pa.binary())], ["path", "content"])

    out = encoders.spread(text_files(spark, sf_dir).select(F.concat("file", F.lit(".lf2")).alias("path"), "content")).mapInArrow(batch.in_passes(make), "path string, content binary")
    return out.withColumns({"format": F.lit("LF2"), "length": F.octet_length("content").cast("long")})


_PADDED = "(octet_length(encode(coalesce(text, ''))) + 15) // 16"


@query("pixel_inflate", f"SELECT doc_id || '.lf2' AS file, 16 AS width, CAST({_PADDED} AS INT) AS height, CAST(16 * ({_PADDED}) AS BIGINT) AS pixels FROM documents")
def pixel_inflate(spark, sf_dir):
    from ringloom.sources.files import decode

    d = decode(image_files(spark, sf_dir)).where("_error is null")
    return d.select(F.col("path").alias("file"), "width", "height", F.octet_length("pixels").cast("long").alias("pixels"))


@query("lf2_header_fields", f"SELECT doc_id || '.lf2' AS file, 16 AS width, CAST({_PADDED} AS INT) AS height, 32 AS transparent_color, 128 AS color_count, 408 AS payload_start FROM documents")
def lf2_header_fields(spark, sf_dir):
    from ringloom.sources.files import lf2_headers

    return lf2_headers(image_files(spark, sf_dir)).select(F.col("path").alias("file"), "width", "height", "transparent_color", "color_count", "payload_start")


@query("token_trace")
def token_trace(spark, sf_dir):
    """Every step of every file."""
    return by_file.steps(image_files(spark, sf_dir))


@query("pairwise_features")
def pairwise_features(spark, sf_dir):
    """The feature table of tied candidates, 84 columns."""
    from ringloom.operators import features

    return features.with_geometry(by_file.ties(image_files(spark, sf_dir)))


@query("variant_agreement")
def variant_agreement(spark, sf_dir, rivals=RIVALS):
    """Tokens of each file that each rival reproduces, of how many."""
    found = by_file.rivals(image_files(spark, sf_dir), rivals).where("same > 0")
    return found.select("file", "variant", "same", "total", (F.col("same") / F.col("total")).alias("rate"))


@query("hopeless_tokens")
def hopeless_tokens(spark, sf_dir, rivals=encoders.HOPELESS):
    """Tokens that no rival of the whole list reproduces: first, last and how many of each file."""
    return by_file.hopeless(image_files(spark, sf_dir), rivals)


@query("variant_divergence")
def variant_divergence(spark, sf_dir, rivals=RIVALS):
    """Where each rival leaves the truth for the first time, and how it does."""
    return by_file.rivals(image_files(spark, sf_dir), rivals).drop("total", "same")


@query("last_writers")
def last_writers(spark, sf_dir):
    """Which token wrote the first byte that each match copies."""
    return by_file.writers(image_files(spark, sf_dir))

"""Memory and tasks that must not follow the input's layout or size."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringloom.operators import encoders
from ringloom.plans import registry  # noqa: F401  before its parts
from ringloom.plans import codec_queries
from ringloom.sources import batch, files, images


def test_lf2_files_are_made_in_many_tasks(spark, tmp_path):
    """one split of the input isn't one task's work."""
    spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some text "), 200).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = codec_queries._encoded_images(spark, str(tmp_path))
    per_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 4 and sum(per_task) == 400 and max(per_task) < 200
    assert made.select("path").distinct().count() == 400


@pytest.fixture(scope="module")
def packed():
    r = np.random.default_rng(5)
    data = np.frombuffer(b" ".join(r.choice([b"alpha", b"beta", b"gamma", b"delta", b"eps"], 60_000)), np.uint8)
    bounds = batch.bounds_of(np.array([len(data)]))
    return data, bounds, *batch.frame(encoders.tokens_of(data, bounds, "chain3_8_first"))


def test_memory_of_expansion(packed):
    """bytes held for each byte of the result."""
    data, bounds, payload, at = packed
    t = batch.read(payload, at, np.diff(bounds))
    tracemalloc.start()
    out, _ = batch.expand(t, np.diff(bounds))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out == data).all()
    assert peak < 50 * len(data)


@pytest.mark.parametrize("kind", ["raw", "bmp", "png", "rgba"])
def test_stretches_of_decoding(spark, kind):
    """F9 F11 F13: files that are decoded together are few, and each has its pixels."""
    text = bytes(range(32, 122)) * 64
    data, bounds = batch.filled(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 16)
    payload, _ = batch.frame(encoders.tokens_of(data, bounds, "chain3_8_first"))
    whole = images.lf2_head(images.Image("lf2", 16, len(data) // 16, b"", [(i, i, i) for i in range(128)], 32)) + payload.tobytes()
    many = batch.passes(iter([_batch([whole] * 400)]), "content", files.STRETCH)
    assert max(sum(map(len, b.column("content").to_pylist())) for b in many) <= 1 << 17
    table = spark.createDataFrame([(f"{i}.lf2", "LF2", bytearray(whole)) for i in range(40)], "path string, format string, content binary")
    got = files.outputs(files.decode(table), kind).groupBy("data").count().collect()
    image = images.read_lf2(whole)
    assert [(bytes(r["data"]), r["count"]) for r in got] == [(images.encode_as(image, kind), 40)]


def _batch(contents):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(contents, pa.binary())], ["content"])

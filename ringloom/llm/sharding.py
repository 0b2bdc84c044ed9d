"""Sharding by jump consistent hashing.

A stable key is hashed to 64 bits and walks forward through ever rarer jumps (Lamping and Veach, 2014); no ring
table is kept, and with one shard more only the keys that move into the new shard move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm._common import grouped_rank

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0..shards-1 of unsigned 64-bit keys."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = keys.astype(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        with np.errstate(over="ignore"):
            key[live] = key[live] * _STEP + np.uint64(1)
        ahead = ((out[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live, ahead = live[ahead < shards], ahead[ahead < shards]
        out[live] = ahead
    return out


def shard_column(key: str, shards: int):
    """Shard of a column. Null is a key like any other."""

    @F.pandas_udf("int")
    def of(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard; no text is shuffled.

    size is the UTF-8 length plus 1 (null text: 1; its checksum is that of no bytes). Repeated ids share a shard and
    have slots of their own; a null id is a key like any other; other columns are not read; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_column(id_col, shards).alias("shard"),
        shard_column(id_col, shards + 1).alias("grown_shard"),
    )
    return grouped_rank(rows, ["shard"], [id_col, "size", "text_crc32"], "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> None:
    """Write all columns under ``path/shard=k``; rows of a shard may come in several files."""
    docs.withColumn("shard", shard_column(id_col, shards)).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))

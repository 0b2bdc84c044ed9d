"""Helpers that the operators of this folder share.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``: all executors
see it, so that a lost executor costs a task and not a result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows; so fewer than HOT_KEYS keys are hot.
HOT_KEYS = 256
#: Columns that tell a row of documents, by id and text.
KEY = ["_none", "_id", "_key"]


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A folder of our own is set only where the session has none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ringloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, Column]]:
    """KEY and text (null: empty) of each row, and the expressions of KEY. A null id comes after all others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = {"_none": F.col(id_col).isNull(), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), "_key": F.xxhash64(text)}
    return docs.select(*[c.alias(k) for k, c in key.items()], text.alias("text")), key


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, spread: str, total: int | None = None) -> DataFrame:
    """Left join of ``right``, which has one row per key, to ``left``, whose keys may be very uneven.

    ``right[count]`` says how many rows of ``left`` the key has. Keys over 1/HOT_KEYS of the rows are fewer
    than HOT_KEYS, so their rows of ``right`` are broadcast; the rows of ``left`` that they serve are then spread
    by ``spread`` and meet no row in the shuffled join that serves the others. ``right`` should be a saved table.
    Keys must not be null (a null key finds nothing).
    """
    values = [c for c in right.columns if c not in keys and c != count]
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    bound = total / HOT_KEYS
    value = F.struct(*values)
    hot = right.where(F.col(count) > bound).select(*keys, value.alias("_hot"))
    cold = right.where(F.col(count) <= bound).select(*keys, value.alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 40)) + 1)
    out = left.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*left.columns, *[found[v].alias(v) for v in values])


def grouped_rank(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within each group, in no particular order across salts.

    A group is split over as many salts as the session has shuffle partitions; a salt's first rank is the
    count of the salts before it. Rows that are equal in ``order`` are interchangeable.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n_parts(df.sparkSession))))
    keys = [*groups, "_salt"]
    before = Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy(*keys).count().withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(first, keys).withColumn(out, F.col("_first") + F.col("_rank") - 1).drop("_salt", "_first", "_rank")


def key_ranges(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points of a bigint key, for buckets of similar row counts."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * parts))).alias("cuts")).first()[0]
    return sorted(set(got or []))


def bucket_of(key: str, cuts: list[int]):
    """Bucket 0..len(cuts) of ``key``: the number of cuts at or below it; null goes to bucket 0."""
    cut = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut, k.to_numpy(np.int64), side="right").astype(np.int32))

    return of(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))


def text_chunks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters (one text at least), with the index of the first; null is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held

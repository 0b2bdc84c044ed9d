"""Seeded samples and splits that a hash of the keys decides, so that they don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.operators.windows import ordered


def draw(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def k_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[str], k: int, seed: int, always: Column | None = None) -> DataFrame:
    """All rows of ``always``, and ``k`` others of each group in the order of their draws."""
    keep = F.lit(False) if always is None else always
    out = df.withColumns({"_always": keep, "_draw": draw(keys, seed)})
    rank = F.row_number().over(ordered([*group, "_always"], ["_draw", *keys]))
    return out.withColumn("_rank", rank).where(F.col("_always") | (F.col("_rank") <= k)).drop("_always", "_draw", "_rank")


def fold(key: str, folds: int, seed: int = 0) -> Column:
    """Fold of a group key, from 0: all rows of a key are in one fold."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(folds))

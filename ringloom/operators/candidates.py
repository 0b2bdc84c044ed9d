"""Match candidates: earlier places of a sequence whose following symbols agree with those at the current place.

Only matches of ``min_len`` symbols or more count, so two places that match share their first ``min_len`` symbols. That makes the
search an equi-join on this n-gram; the window is a residual range, and joining each block of ``window`` places with itself and
the block before keeps a frequent n-gram from meeting all its places in the sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(a, i) != F.get(b, i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differs), n)).cast("long")


def match_candidates(rows: DataFrame, key: Sequence[str], pos: str, symbol: str, window: int = 4096, min_len: int = 3, max_len: int = 18) -> DataFrame:
    """``rows(key, pos, symbol)`` with gapless positions -> key, pos, cand_pos, dist, len for every candidate."""
    ahead = Window.partitionBy(*key).orderBy(pos).rowsBetween(0, max_len - 1)
    places = rows.select(*key, F.col(pos).alias("pos"), F.collect_list(symbol).over(ahead).alias("ahead"))
    places = places.where(F.size("ahead") >= min_len).withColumn("gram", F.slice("ahead", 1, min_len)).withColumn("block", F.floor(F.col("pos") / window))
    late = places.select(*key, "gram", "block", "pos", "ahead")
    early = places.select(*key, "gram", F.explode(F.array("block", F.col("block") + 1)).alias("block"), F.col("pos").alias("cand_pos"), F.col("ahead").alias("cand_ahead"))
    found = late.join(early, [*key, "gram", "block"]).where((F.col("pos") - F.col("cand_pos")).between(1, window))
    return found.select(*key, "pos", "cand_pos", (F.col("pos") - F.col("cand_pos")).alias("dist"), common_prefix(F.col("ahead"), F.col("cand_ahead")).alias("len"))


def tie_sets(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """The longest candidates of each place: n_cands, n_max, max_len and the rank by distance (1 is nearest)."""
    w = Window.partitionBy(*key, "pos")
    longest = F.max("len").over(w)
    out = candidates.withColumns({"max_len": longest, "n_cands": F.count("*").over(w)}).where(F.col("len") == F.col("max_len"))
    return out.withColumns({"n_max": F.count("*").over(w), "rank": F.row_number().over(w.orderBy("dist")).cast("long")})


def overflow_histogram(df: DataFrame, value: str, top: int, out: str = "bucket") -> DataFrame:
    """Counts by value, where ``top`` stands for itself and all above."""
    return df.groupBy(F.least(F.col(value), F.lit(top)).cast("long").alias(out)).agg(F.count("*").alias("n"))

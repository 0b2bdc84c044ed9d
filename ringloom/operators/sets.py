"""Set algebra over key sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def venn(sets: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Every key of the union with a flag for each set: one aggregation, whatever number of sets."""
    tagged = None
    for name, df in sets.items():
        one = df.select(*key, F.lit(name).alias("_set"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(*key).agg(*[F.bool_or(F.col("_set") == n).alias(f"in_{n}") for n in sets])


def algebra(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sizes of the intersection, of both differences and of the union."""
    v = venn({"a": a, "b": b}, key)
    return v.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("both"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b"), F.count("*").alias("either"))

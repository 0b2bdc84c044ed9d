"""Position-by-position comparison of sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positional_diff(left: DataFrame, right: DataFrame, key: Sequence[str], pos: str, value: str) -> DataFrame:
    """Full outer join by position: key, pos, left_value, right_value, differs. A place that one side lacks differs."""
    a = left.select(*key, pos, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*key, pos, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, [*key, pos], "full")
    differs = F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))
    return both.select(*key, pos, "left_value", "right_value", differs.alias("differs"))


def first_divergence(diff: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """key, length (of the longer side), n_diff, first_div (null where all agree), and the values there."""
    at = F.when(F.col("differs"), F.struct(pos, "left_value", "right_value"))
    out = diff.groupBy(*key).agg(F.count("*").alias("length"), F.count_if("differs").alias("n_diff"), F.min(at).alias("at"))
    return out.select(*key, "length", "n_diff", F.col(f"at.{pos}").alias("first_div"), F.col("at.left_value").alias("left_value"), F.col("at.right_value").alias("right_value"))


def array_divergence(pairs: DataFrame, key: Sequence[str], left: str, right: str) -> DataFrame:
    """``first_divergence`` of two sequences that a row holds whole as arrays without nulls; pairs that are both empty have no row."""
    differs = F.zip_with(left, right, lambda a, b: ~a.eqNullSafe(b))  # a place that one side lacks is null
    p = pairs.select(*key, left, right, differs.alias("_differs"))
    at = F.array_position("_differs", True)
    p = p.select(*key, F.size("_differs").cast("long").alias("length"), F.size(F.filter("_differs", lambda x: x)).cast("long").alias("n_diff"), F.when(at > 0, at - 1).alias("first_div"), left, right).where("length > 0")
    value = lambda c: F.get(F.col(c), F.col("first_div").cast("int"))
    return p.select(*key, "length", "n_diff", "first_div", value(left).alias("left_value"), value(right).alias("right_value"))


def match_rate(diff: DataFrame) -> DataFrame:
    """Micro-averaged rate of places that agree, over the longer sides; takes what ``first_divergence`` or ``array_divergence`` gives."""
    zero = F.lit(0).cast("long")
    n = F.coalesce(F.sum("length"), zero)
    same = F.coalesce(F.sum(F.col("length") - F.col("n_diff")), zero)
    return diff.agg(n.alias("places"), same.alias("same"), F.when(n == 0, 0.0).otherwise(same / n).alias("rate"))


def bucket(value: Column, bounds: Sequence[int], names: Sequence[str]) -> Column:
    """Name of the first bound that the value doesn't exceed; the last name beyond all; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for b, name in zip(bounds, names, strict=False):
        out = out.when(value <= b, name)
    return out.otherwise(names[-1])


def array_diff_count(a: Column, b: Column) -> Column:
    """Places at which two arrays differ, with the difference of their lengths."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"])))

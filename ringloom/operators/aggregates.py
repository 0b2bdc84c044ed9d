"""Aggregates over groups: quantiles, conformance, heat-maps, collisions, selectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles that are values of the data: the least one that a share of the rows doesn't exceed."""
    return df.groupBy(*keys).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, q in shares.items()])


def conformance(df: DataFrame, key: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """How many groups satisfy each check in all their rows, of how many."""
    per = df.groupBy(*key).agg(*[F.bool_and(c).alias(n) for n, c in checks.items()])
    return per.agg(F.count("*").alias("groups"), *[F.count_if(n).alias(f"all_{n}") for n in checks])


def value_counts(df: DataFrame, key: Sequence[str], size: str = "size", out: str = "groups") -> DataFrame:
    """How many groups have each number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias(size)).groupBy(size).agg(F.count("*").alias(out))


def heatmap(df: DataFrame, keys: Sequence[str], row: Column, col: Column, rows: tuple[int, int], cols: Sequence[int], prefix: str = "c") -> DataFrame:
    """Counts by clamped row and column, with a column for each of ``cols``."""
    clamp = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high)).cast("int")
    cells = df.withColumns({"row": clamp(row, *rows), "_col": clamp(col, min(cols), max(cols))})
    out = cells.groupBy(*keys, "row").pivot("_col", list(cols)).agg(F.count(F.lit(1)))
    return out.select(*keys, "row", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"{prefix}{c}") for c in cols])


def collisions(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Groups of equal features with more than one label, and their rows."""
    g = df.groupBy(*features).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).where("labels > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def selector_rates(df: DataFrame, scene: Sequence[str], tie: Sequence[str], selectors: Mapping[str, Column], chosen: Column) -> DataFrame:
    """How often the row that a selector ranks first (least value, then ``tie``) is a chosen one: one pass for all selectors."""
    firsts = [F.min(F.struct(c.alias("v"), *tie, chosen.alias("hit"))).alias(n) for n, c in selectors.items()]
    per = df.groupBy(*scene).agg(*firsts)
    sums = per.agg(F.count("*").alias("scenes"), *[F.count_if(F.col(n)["hit"]).alias(n) for n in selectors])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("selector"), "scenes", F.col(n).alias("hits")) for n in selectors])).alias("r")).select("r.*")


def gini(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Gini impurity of the labels of each group."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.sum("n").alias("n"), (1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"))


def sample_of(df: DataFrame, key: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """The ``n`` least values of each group as an array, by bounded windows rather than by collecting groups."""
    from ringloom.operators.windows import ordered

    few = df.withColumn("_k", F.row_number().over(ordered(key, [value]))).where(F.col("_k") <= n)
    return few.groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias(out))


def parameter_grid(df: DataFrame, params: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """Evaluate a predicate for each row of a parameter table (100 rows at most, which is checked, so it is broadcast)."""
    if params.limit(101).count() > 100:
        raise ValueError("a parameter table has 100 rows at most")
    return df.crossJoin(F.broadcast(params)).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))


def appearance_sizes(df: DataFrame, keys: Sequence[str], group: str, order: str) -> DataFrame:
    """Size of each group, and its place by the first row that it has within the keys."""
    sizes = df.groupBy(*keys, group).agg(F.count("*").alias("size"), F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1
    return sizes.withColumn("place", place).drop("_first")

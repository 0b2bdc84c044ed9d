"""History, look-ahead and rank features over ordered rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[str | Column]


def ordered(keys: Sequence[str], order: Order):
    return Window.partitionBy(*keys).orderBy(*order)


def position(df: DataFrame, keys: Sequence[str], order: Order, out: str = "pos") -> DataFrame:
    """0-based position of a row in its group."""
    return df.withColumn(out, (F.row_number().over(ordered(keys, order)) - 1).cast("long"))


def lag_history(df: DataFrame, keys: Sequence[str], order: Order, column: str, depth: int, default: object, prefix: str = "prev") -> DataFrame:
    """The values of the ``depth`` rows before, over all rows of the group: prefix_1 is the nearest."""
    w = ordered(keys, order)
    return df.withColumns({f"{prefix}_{k}": F.lag(column, k, default).over(w) for k in range(1, depth + 1)})


def look_ahead(df: DataFrame, keys: Sequence[str], order: Order, column: str, depth: int, default: object, prefix: str = "next") -> DataFrame:
    w = ordered(keys, order)
    return df.withColumns({f"{prefix}_{k}": F.lead(column, k, default).over(w) for k in range(1, depth + 1)})


def running_cursor(df: DataFrame, keys: Sequence[str], order: Order, length: str, out: str = "cursor") -> DataFrame:
    """Sum of the lengths of all rows before."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)))


def recent_frame(df: DataFrame, keys: Sequence[str], order: Order, depth: int, **aggregates: Column) -> DataFrame:
    """Aggregates over the ``depth`` rows before the current one."""
    w = ordered(keys, order).rowsBetween(-depth, -1)
    return df.withColumns({name: a.over(w) for name, a in aggregates.items()})


def last_of_kind(df: DataFrame, keys: Sequence[str], order: Order, value: Column, out: str) -> DataFrame:
    """The latest non-null ``value`` before the current row."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def group_extent(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Least and greatest value of the group beside each row, and the row's distances from them."""
    w = Window.partitionBy(*keys)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumns({f"{column}_min": low, f"{column}_max": high, f"{column}_above_min": F.col(column) - low, f"{column}_below_max": high - F.col(column)})


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Order, out: str = "rank", base: int = 1) -> DataFrame:
    return df.withColumn(out, (F.row_number().over(ordered(keys, order)) + (base - 1)).cast("long"))


def best_row(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of each group; ``order`` must settle ties."""
    return df.withColumn("_rank", F.row_number().over(ordered(keys, order))).where("_rank = 1").drop("_rank")


def first_groups(df: DataFrame, keys: Sequence[str], group: Order, n: int) -> DataFrame:
    """Rows of the first ``n`` distinct groups of each key."""
    return df.withColumn("_rank", F.dense_rank().over(ordered(keys, group))).where(F.col("_rank") <= n).drop("_rank")


def runs(df: DataFrame, keys: Sequence[str], order: Order, column: str, out: str = "run") -> DataFrame:
    """Number of each stretch of equal values (gaps and islands), from 0."""
    w = ordered(keys, order)
    starts = F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", starts).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")

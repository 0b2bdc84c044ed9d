"""Joins that the workloads need beside plain equi-joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, on: Column, values: dict[str, object]) -> DataFrame:
    """Left join of a small table with a default for each value; Spark broadcasts it where its size allows."""
    joined = df.join(table, on, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(default)) for c, default in values.items()})


def member(df: DataFrame, other: DataFrame, key: Sequence[str], out: str) -> DataFrame:
    """Whether the row's key is in ``other``, as a column."""
    found = other.select(*key).distinct().withColumn("_found", F.lit(True))
    return df.join(found, list(key), "left").withColumn(out, F.col("_found").isNotNull()).drop("_found")


def interval_join(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with the span of its key that covers it: start <= at < end.

    Spans are laid out over bins of ``width``, so that the join is an equi-join on key and bin.
    """
    last = F.greatest(F.floor((F.col(end) - 1) / width), F.floor(F.col(start) / width))
    binned = spans.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), last)))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*key, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bin")


def nearest(df: DataFrame, palette: DataFrame, distance: Callable[[Column], Column], index: str, keep: Sequence[str], out: str = "nearest", most: int | None = 256) -> DataFrame:
    """Index of the nearest palette row for each row of ``df`` (lowest index on a tie; null where no distance is known).

    A theta join with the broadcast palette gives the least distance, and one on that distance the rows of the palette that have it, so that both
    groupings keep plain values in a hash table. ``distance`` takes a palette row. A palette has ``most`` rows at most, which is checked; None: any number.
    """
    if most is not None and palette.limit(most + 1).count() > most:
        raise ValueError(f"a palette has {most} rows at most")
    whole, d = F.broadcast(palette.select(F.struct(*palette.columns).alias("_p"))), distance(F.col("_p"))
    least = df.crossJoin(whole).groupBy(*[F.col(k).alias(f"_{k}") for k in keep]).agg(F.min(d).alias("_d"))
    known = df.join(least, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keep]))
    best = known.join(whole, F.col("_d") == d, "left").groupBy(*keep).agg(F.min(F.col("_p")[index]).alias(out), F.min("_d").alias("distance"))
    return best.select(*keep, out, "distance")


def override(df: DataFrame, choices: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values of ``choices`` where it has the key, else those of ``df``."""
    new = choices.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(new, list(key), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def remaining(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet: the resumable batch."""
    return todo.join(done.select(*key), list(key), "left_anti")

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm._common import attach, saved

#: Far above what a logarithmic number of rounds needs.
MAX_ROUNDS = 60
#: So many edges at most are one task's work: the rounds of more would cost more than they spread.
FEW = 1 << 14


def _state(edges: DataFrame) -> tuple:
    """Number of edges and 128 bits of their set; no sum that could overflow."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(h.cast("decimal(20,0)"))).first())


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges (u, v)."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.setdefault(x, x)) != x:
            top[x] = x = top[y]
        return x

    for b in batches:
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            u, v = find(u), find(v)
            top[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_pydict({"node": list(top), "component": [find(x) for x in list(top)]}, schema=pa.schema([("node", pa.int64()), ("component", pa.int64())]))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``edges(a, b)`` of bigint nodes -> ``node, component``: the smallest node that each node can reach.

    Loops, repeats and either direction are fine; rows with a null end are ignored; a node without an edge to
    another node has no row. Each round ends in a table of the shared folder; the driver holds two numbers a round.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    now = saved(pair.distinct(), "edges")
    state = _state(now)
    if state[0] <= FEW:
        return now.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select("v", "u"))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "large")
        # every larger neighbour of u is tied to the least of u's neighbourhood
        large = attach(both, least, ["u"], "n", "v", 2 * state[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.distinct(), "star")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
        small = attach(large, least, ["u"], "n", "v", state[0])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = saved(small.where("u != v").distinct(), "edges")
        was, state = state, _state(now)
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())

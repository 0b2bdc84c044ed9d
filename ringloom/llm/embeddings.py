"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to unit length; then cosine >= t is Euclidean distance <= r = sqrt(2 - 2t). Within a label (and a number of
dimensions), pivots are drawn from the vectors by hash, and a vector belongs to the cell of its nearest pivot. If x is in cell i and y in
cell j and they are within r, the triangle inequality gives d(x, j) <= d(x, i) + 2r, and x is within r of the plane between the two pivots:
(d(x, j)^2 - d(x, i)^2) / (2 d(i, j)) <= r. A vector is copied to each later cell for which both hold, and to no other. Every cell is then
joined on its own; it is cut into blocks of bounded size, and each pair of blocks is one matrix product in double precision.

Equal vectors of a label are one point with a weight. A block pair returns counts of links and a forest with the components of
its links, never its pairs. Where vectors have no structure (high dimension, wide radius) the bounds spare few cells: the join stays
exact, and its work within a label grows with the square of the label's distinct vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm._common import attach, n_parts, saved
from ringloom.llm.graph import components

#: Rows of a block; vectors a pivot, about; pivots a label, and pivots in all (this bounds what the driver and each task hold).
BLOCK, CELL, PIVOTS_PER_LABEL, PIVOTS = 1024, 2048, 64, 2048
#: Slack for rounding in the bounds that choose copies; the join itself compares with the threshold as it is.
SLACK = 1e-6


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1; by the largest component first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def usable(column: str):
    """Neither null nor zero, with finite components only."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def cells(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and a matrix that says to which later cells it is copied."""
    square = np.maximum(0, 2 - 2 * unit @ pivots.T)
    home = square.argmin(axis=1)
    near = square[np.arange(len(unit)), home][:, None]
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    by_triangle = np.sqrt(square) <= np.sqrt(near) + 2 * radius + SLACK
    by_plane = square - near <= 2 * radius * apart + SLACK
    return home, by_triangle & by_plane & (np.arange(len(pivots))[None] > home[:, None])


def block_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> np.ndarray:
    """Links between two blocks of unit vectors, or within one."""
    if b is not None:
        return a @ b.T >= threshold
    out = a @ a.T >= threshold
    np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray, within: bool) -> list[tuple[int, int]]:
    """Edges (row, column) of ``links`` with the same components."""
    rows, cols = np.nonzero(links.any(axis=1))[0], np.nonzero(links.any(axis=0))[0]
    if not len(rows):
        return []
    m = links[np.ix_(rows, cols)]
    if within:  # rows and columns are the same points
        label, out = np.arange(len(rows)), []
        waiting = np.ones(len(rows), bool)
        while waiting.any():
            seen, edge = np.zeros(len(rows), bool), [int(np.argmax(waiting))]
            seen[edge] = True
            while edge:
                i = edge.pop()
                new = np.nonzero(m[i] & ~seen)[0]
                out += [(int(rows[i]), int(rows[j])) for j in new]
                seen[new] = True
                edge += new.tolist()
            waiting &= ~seen
        return out
    out, free_r, free_c = [], np.ones(len(rows), bool), np.ones(len(cols), bool)
    for start in range(len(rows)):
        if not free_r[start]:
            continue
        free_r[start] = False
        edge = [(0, start)]
        while edge:
            side, i = edge.pop()
            if side == 0:
                new = np.nonzero(m[i] & free_c)[0]
                free_c[new] = False
                out += [(int(rows[i]), int(cols[j])) for j in new]
                edge += [(1, int(j)) for j in new]
            else:
                new = np.nonzero(m[:, i] & free_r)[0]
                free_r[new] = False
                out += [(int(rows[j]), int(cols[i])) for j in new]
                edge += [(0, int(j)) for j in new]
    return out


def _pivots(points: DataFrame) -> dict[tuple, np.ndarray]:
    """(label, dimensions) -> unit pivots, for groups of more than CELL points; PIVOTS in all at most, largest groups first."""
    sizes = points.groupBy("label", "dims").count().where(F.col("count") > CELL).orderBy(F.desc("count"), "label", "dims").limit(PIVOTS // 2).collect()
    left, want = PIVOTS, []
    for r in sizes:
        k = min(left, PIVOTS_PER_LABEL, -(-r["count"] // CELL))
        if k > 1:
            want.append((r["label"], r["dims"], k, r["count"]))
            left -= k
    if not want:
        return {}
    table = points.sparkSession.createDataFrame(want, f"label {dict(points.dtypes)['label']}, dims int, k int, size long")
    drawn = points.join(F.broadcast(table), ["label", "dims"])
    # about 4k + 8 of each group by a hash of the point, then the first k: each draw is a small share of a group
    drawn = drawn.where(F.pmod(F.xxhash64("vector", F.lit("pivot")), F.col("size")) < 4 * F.col("k") + 8).select("label", "dims", "k", "node", "vector")
    out: dict[tuple, np.ndarray] = {}
    for (label, dims), group in drawn.toPandas().groupby(["label", "dims"]):
        rows = group.sort_values("node").head(int(group["k"].iloc[0]))
        unit = _unit(np.array(rows["vector"].tolist(), float))
        out[label, dims] = np.unique(unit, axis=0)
    return out


def _placed(points: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """A row for each point's own cell (home) and for each copy."""
    kind = dict(points.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.to_pandas()
            for (label, dims), g in f.groupby(["label", "dims"], sort=False):
                found = pivots.get((label, dims))
                cell, home, at = np.zeros(len(g), int), np.ones(len(g), bool), np.arange(len(g))
                if found is not None and len(found) > 1:
                    cell, copies = cells(_unit(np.array(g["vector"].tolist(), float)), found, radius)
                    i, j = np.nonzero(copies)
                    at, cell, home = np.concatenate([at, i]), np.concatenate([cell, j]), np.concatenate([home, np.zeros(len(i), bool)])
                for s in range(0, len(at), 4096):
                    k = at[s : s + 4096]
                    out = g.iloc[k].assign(cell=cell[s : s + 4096].astype(np.int32), home=home[s : s + 4096])
                    yield pa.RecordBatch.from_pandas(out[["label", "dims", "node", "n", "vector", "cell", "home"]], schema=b.schema.append(pa.field("cell", pa.int32())).append(pa.field("home", pa.bool_())), preserve_index=False)

    return points.select("label", "dims", "node", "n", "vector").mapInArrow(run, f"label {kind}, dims int, node long, n long, vector array<double>, cell int, home boolean")


def _joined(placed: DataFrame, threshold: float) -> DataFrame:
    """node, weight, other: the weight of the links of a node in a block pair (other is null), or a link of a forest (weight is 0)."""
    spark = placed.sparkSession
    keys = ["label", "dims", "cell"]
    sizes = placed.groupBy(*keys).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("copies"))
    blocks = [F.ceil(F.greatest(F.col(c), F.lit(1)) / BLOCK).cast("int") for c in ("homes", "copies")]
    sizes = sizes.withColumns({"hb": blocks[0], "cb": blocks[1], "rows": F.col("homes") + F.col("copies")})
    sizes = saved(sizes.select(*keys, "rows", "hb", "cb"), "cells")
    placed = attach(placed, sizes, keys, "rows", "node")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("cb"))).cast("int")
    placed = placed.withColumn("own", own)
    # home block h meets home blocks from h on (a side) and all copy blocks; copy block c meets all home blocks
    pair = lambda a, b, kind: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(kind).alias("kind"))
    upper = F.transform(F.sequence(F.col("own"), F.col("hb") - 1), lambda b: pair(F.col("own"), b, "hh"))
    lower = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda a: pair(a, F.col("own"), "hh"))).otherwise(F.array().cast("array<struct<a:int,b:int,kind:string>>"))
    out = F.transform(F.sequence(F.lit(0), F.col("cb") - 1), lambda b: pair(F.col("own"), b, "hc"))
    back = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda a: pair(a, F.col("own"), "hc"))
    tasks = F.when(F.col("home"), F.concat(upper, lower, out)).otherwise(back)
    placed = placed.withColumn("t", F.explode(tasks)).select(*keys, "t.a", "t.b", "t.kind", "node", "n", "vector", "home", "own")

    def join(f: pd.DataFrame) -> pd.DataFrame:
        kind, a, b = f["kind"].iloc[0], f["a"].iloc[0], f["b"].iloc[0]
        within = kind == "hh" and a == b
        left = f if within else f[f["home"] & (f["own"] == a)] if kind == "hc" else f[f["own"] == a]
        right = left if within else f[~f["home"]] if kind == "hc" else f[f["own"] == b]
        empty = pd.DataFrame({"node": np.zeros(0, np.int64), "weight": np.zeros(0, np.int64), "other": pd.array([], "Int64")})
        if left.empty or right.empty:
            return empty
        u = _unit(np.array(left["vector"].tolist(), float))
        links = block_links(u, None if within else _unit(np.array(right["vector"].tolist(), float)), threshold)
        if not links.any():
            return empty
        x, y = left["node"].to_numpy(), right["node"].to_numpy()
        sums = [(x, links @ right["n"].to_numpy())] + ([] if within else [(y, left["n"].to_numpy() @ links)])
        edges = np.array(forest(links, within), np.int64).reshape(-1, 2)
        node, weight = np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums])
        hit = weight > 0
        return pd.DataFrame({
            "node": np.concatenate([node[hit], x[edges[:, 0]]]),
            "weight": np.concatenate([weight[hit], np.zeros(len(edges), np.int64)]),
            "other": pd.array([pd.NA] * int(hit.sum()) + y[edges[:, 1]].tolist(), "Int64"),
        })

    placed = placed.repartition(n_parts(spark), *keys, "a", "b", "kind")
    return placed.groupBy(*keys, "a", "b", "kind").applyInPandas(join, "node long, weight long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept for each input row.

    A row links with the other rows of its label (and number of dimensions) whose cosine is the threshold or more; equal vectors link
    with each other. Rows with a null label, or a vector that is null, empty, zero or has null or non-finite components, link with
    nothing: n_links 0, component_id their own id. Rows with equal ids are rows of their own. A null id stays null, is not kept, and its
    row still links. Other columns are not read; no rows give no rows.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.col("label").isNotNull() & usable("vector")
    rows = rows.withColumn("vector", F.when(fine, F.transform("vector", lambda x: x + F.lit(0.0)))).withColumn("dims", F.size("vector"))
    good = rows.where("vector is not null")
    points = good.groupBy("label", "dims", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    points = saved(points.withColumn("node", F.monotonically_increasing_id()), "vectors")  # ids may repeat, points don't
    result = saved(_joined(_placed(points, _pivots(points), radius), threshold), "links")
    weights = result.where("other is null").groupBy("node").agg(F.sum("weight").alias("weight"))
    group = components(result.where("other is not null"), "node", "other")
    points = points.join(weights, "node", "left").join(group, "node", "left")
    points = saved(points.select("label", "vector", "node", "n", "least", (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")), "vectors")
    roots = saved(points.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("points")), "roots")
    points = saved(attach(points, roots, ["root"], "points", "node").select("label", "vector", "n", "n_links", "component_id"), "vectors")
    found = attach(good, points, ["label", "vector"], "n", "id").select("id", "n_links", "component_id")
    out = found.union(rows.where("vector is null").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

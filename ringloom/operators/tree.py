"""Decision trees: exhaustive splits by Gini gain, compiled to CASE expressions for prediction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_gains(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, threshold, n, gain for every threshold between two neighbouring values.

    Labels are counted by value first, so the prefix sums run over distinct values and not over rows.
    """
    long = df.select(*keys, F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("f")).select(*keys, "y", "f.*")
    counts = long.groupBy(*keys, "feature", "value", "y").agg(F.count("*").alias("c"))
    # the sum of squared class counts on the left of a threshold grows by (n + c)^2 - n^2 at each value
    group = [*keys, "feature"]
    up = Window.partitionBy(*group, "y").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"left_y": F.sum("c").over(up), "all_y": F.sum("c").over(Window.partitionBy(*group, "y"))})
    n_before, n_now = F.col("left_y") - F.col("c"), F.col("left_y")
    r_before, r_now = F.col("all_y") - n_before, F.col("all_y") - n_now
    steps = counts.withColumns({"dl": n_now * n_now - n_before * n_before, "dr": r_now * r_now - r_before * r_before, "sq": F.when(F.col("left_y") == F.col("c"), F.col("all_y") * F.col("all_y")).otherwise(0)})
    by = steps.groupBy(*group, "value").agg(F.sum("c").alias("c"), F.sum("dl").alias("dl"), F.sum("dr").alias("dr"), F.sum("sq").alias("sq"))
    w = Window.partitionBy(*group).orderBy("value")
    run, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*group)
    by = by.withColumns({"nl": F.sum("c").over(run), "n": F.sum("c").over(whole), "sl": F.sum("dl").over(run), "s": F.sum("sq").over(whole), "sr": F.sum("dr").over(run), "following": F.lead("value").over(w)})
    nl, n = F.col("nl"), F.col("n")
    nr, sr = n - nl, F.col("s") + F.col("sr")
    impurity = lambda s, m: 1 - s / (m * m)
    gain = impurity(F.col("s"), n) - (nl * impurity(F.col("sl"), nl) + nr * impurity(sr, nr)) / n
    return by.where(F.col("following").isNotNull()).select(*group, ((F.col("value") + F.col("following")) / 2).alias("threshold"), "n", gain.alias("gain"))


def best_splits(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """The split of the greatest gain for each key; ties: the feature first in ``features``, then the lower threshold."""
    order = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    gains = split_gains(df, features, label, keys).withColumn("_r", F.round("gain", 12))
    best = gains.groupBy(*keys).agg(F.min_by(F.struct("feature", "threshold", "n", "gain"), F.struct(-F.col("_r"), order, F.col("threshold"))).alias("b"))
    return best.select(*keys, "b.*")


@dataclass
class Node:
    """A leaf has a choice; an inner node sends values up to its threshold left."""

    choice: int | None = None
    feature: str = ""
    threshold: float = 0.0
    left: Node | None = field(default=None, repr=False)
    right: Node | None = field(default=None, repr=False)

    def predict(self, row: dict) -> int | None:
        """A missing feature counts as minus infinity and goes left."""
        if self.left is None or self.right is None:
            return self.choice
        value = row.get(self.feature)
        return (self.left if value is None or value <= self.threshold else self.right).predict(row)

    def column(self, names: Sequence[str]) -> Column:
        """The tree as nested CASE expressions; a feature that the rows lack always goes left."""
        if self.left is None or self.right is None:
            return F.lit(self.choice)
        if self.feature not in names:
            return self.left.column(names)
        right = F.coalesce(F.col(self.feature) > self.threshold, F.lit(False))
        return F.when(right, self.right.column(names)).otherwise(self.left.column(names))

    def rules(self, limit: int | None = None) -> list[str]:
        """A line for each leaf: its conditions, then its choice."""
        out: list[str] = []

        def walk(node: Node, path: list[str]) -> None:
            if node.left is None or node.right is None:
                out.append(f"if {' and '.join(path) or 'always'}: choose {node.choice}")
                return
            walk(node.left, [*path, f"{node.feature} <= {node.threshold:g}"])
            walk(node.right, [*path, f"{node.feature} > {node.threshold:g}"])

        walk(self, [])
        return out if limit is None else out[:limit]

    def table(self) -> list[tuple]:
        """Rows (node_id, feature, threshold, left, right, choice) in preorder."""
        rows: list[tuple] = []

        def walk(node: Node) -> int:
            i = len(rows)
            rows.append(())
            if node.left is None or node.right is None:
                rows[i] = (i, None, None, None, None, node.choice)
            else:
                left, right = walk(node.left), walk(node.right)
                rows[i] = (i, node.feature, float(node.threshold), left, right, None)
            return i

        walk(self)
        return rows

    @classmethod
    def from_table(cls, rows: Sequence[tuple], at: int = 0) -> Node:
        by = {r[0]: r for r in rows}
        _, feature, threshold, left, right, choice = by[at]
        return cls(choice) if feature is None else cls(None, feature, threshold, cls.from_table(rows, left), cls.from_table(rows, right))


def train(df: DataFrame, features: Sequence[str], label: str, max_depth: int) -> Node:
    """Grow a tree level by level: one job splits all open nodes of a level; the driver holds nodes alone.

    A node is a leaf at ``max_depth``, if it is pure, or if no split gains anything; it chooses the most frequent label (the least
    one on a tie).
    """
    root = Node()
    level = [root]
    path: dict[int, Node] = {0: root}
    for depth in range(max_depth + 1):
        where = _node_column(root, path, features)
        rows = df.withColumn("_node", where).where(F.col("_node").isNotNull())
        votes = rows.groupBy("_node", label).agg(F.count("*").alias("c")).groupBy("_node").agg(F.max_by(label, F.struct("c", -F.col(label))).alias("choice"), F.count("*").alias("labels"))
        open_ids = []
        for r in votes.collect():
            path[r["_node"]].choice = r["choice"]
            if r["labels"] > 1:
                open_ids.append(r["_node"])
        if depth == max_depth or not open_ids:
            break
        found = best_splits(rows.where(F.col("_node").isin(open_ids)), features, label, ["_node"]).where("gain > 1e-12").collect()
        level, new = [], {}
        for r in found:
            node = path[r["_node"]]
            node.feature, node.threshold, node.left, node.right = r["feature"], r["threshold"], Node(), Node()
            new[2 * r["_node"] + 1], new[2 * r["_node"] + 2] = node.left, node.right
            level += [node.left, node.right]
        if not level:
            break
        path = new
    return root


def _node_column(root: Node, path: dict[int, Node], names: Sequence[str]) -> Column:
    """Number of the open node that a row falls into, null for finished leaves."""
    number = {id(n): i for i, n in path.items()}

    def walk(node: Node) -> Column:
        if node.left is None or node.right is None:
            return F.lit(number.get(id(node))).cast("long")
        return F.when(F.coalesce(F.col(node.feature) > node.threshold, F.lit(False)), walk(node.right)).otherwise(walk(node.left))

    return walk(root)

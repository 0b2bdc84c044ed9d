"""Vectors and components against brute force."""

import random

import numpy as np
import pytest

from ringloom.llm import embeddings
from ringloom.llm.graph import components


def brute(rows, threshold):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.sqrt(v @ v)

    u = [unit(v) if label is not None else None for _, v, label, *_ in rows]
    n = len(rows)
    link = lambda i, j: i != j and u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold
    near = [[j for j in range(n) if link(i, j)] for i in range(n)]
    out = []
    for i in range(n):
        seen, edge = {i}, [i]
        while edge:
            new = [j for j in near[edge.pop()] if j not in seen]
            seen |= set(new)
            edge += new
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def vectors(seed, n, dims, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dims))
    rows = []
    for i in range(n):
        v = (centres[r.integers(8)] + r.normal(size=dims) * spread).astype(np.float32).tolist()
        if rows and r.random() < 0.15 and rows[-1][1]:
            v = list(rows[r.integers(len(rows))][1] or v)
        rows.append((i, v, int(r.integers(3)), "clash", 1))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, node string, n int"


@pytest.mark.parametrize(("cell", "block", "spread"), [(20, 8, 0.05), (30, 16, 0.3), (2048, 1024, 0.1), (15, 1000, 1.0)])
def test_range_join(spark, monkeypatch, cell, block, spread):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors(cell, 240, 6, spread)
    odd = [[0.0] * 6, None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [], [1.0, 2.0], [1.0, 2.0], [-0.0, 0.0, 1.0], [0.0, 0.0, 2.0]]
    rows += [(1000 + i, v, 1, "x", 2) for i, v in enumerate(odd)] + [(2000, rows[0][1], None, "x", 2)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.98).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows, 0.98)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_and_repeats(spark):
    rows = [(None, [1.0, 0.0], 1, "", 0), (7, [1.0, 0.0], 1, "", 0), (7, [1.0, 0.01], 1, "", 0), (None, [0.0, 1.0], 1, "", 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["n_links"], str(r["vec_id"])) for r in got) == [(0, "None"), (2, "7"), (2, "7"), (2, "None")]
    assert all(r["component_id"] == 7 for r in got if r["n_links"])


def test_block_forest_spans_the_links():
    r = np.random.default_rng(0)
    for within in (True, False):
        for p in (0.0, 0.02, 0.2):
            m = r.random((40, 40)) < p
            if within:
                m |= m.T
                np.fill_diagonal(m, False)
            f = embeddings.forest(m, within)
            key = (lambda i, side: i) if within else (lambda i, side: (side, i))

            def parts(edges, key=key):
                group = {}
                for i, j in edges:
                    a, b = group.setdefault(key(i, 0), {key(i, 0)}), group.setdefault(key(j, 1), {key(j, 1)})
                    if a is not b:
                        a |= b
                        for x in b:
                            group[x] = a
                return {frozenset(g) for g in group.values()}

            assert all(m[i, j] for i, j in f) and parts(f) == parts(np.argwhere(m).tolist())


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(kind)
    n = 120
    order = r.sample(range(n), n)
    edges = {"chain": list(zip(order, order[1:], strict=False)), "star": [(5, i) for i in range(n)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(80)], "none": []}[kind]
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([(a, b) for a, b in edges] + [(None, 3)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: least[x] for x in nodes}

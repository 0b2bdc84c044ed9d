"""The production step count meets targets for rare domains, and unreachable ones settle at the optimum."""

import numpy as np
import pytest

from ringloom.llm import mixing


def table_of(spark, tokens, p):
    rows = [(i, int(t), 1, *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p, strict=True))]
    return spark.createDataFrame(rows, "id int, tokens long, copies_in long, " + ", ".join(f"p{k} double" for k in range(p.shape[1])))


def sums_of(table, rate, k):
    rows = table.withColumn("r", rate).collect()
    return [sum(x["r"] * x["tokens"] * x[f"p{i}"] for x in rows) for i in range(k)], [x["r"] for x in rows]


@pytest.mark.parametrize(("rare", "target"), [(2, 0.1), (2, 0.3), (5, 0.1)])
def test_a_rare_domain_reaches_its_target(spark, rare, target):
    p = np.zeros((1000, 2))
    p[:, 0] = 1
    p[:rare] = [0, 1]
    table = table_of(spark, np.full(1000, 50), p)
    rate, _, wanted = mixing.fit_rates(table, [1 - target, target])
    assert sums_of(table, rate, 2)[0] == pytest.approx(wanted, rel=1e-3)


def test_unreachable_targets_settle_at_the_optimum(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 0.2, 0.2], 200) * 0.9 + 0.1 / 3  # no row is free of the unwanted domain
    tokens = rng.integers(5, 90, 200)
    table = table_of(spark, tokens, p)
    with pytest.warns(UserWarning, match="can't all be met"):
        rate, before, wanted = mixing.fit_rates(table, [0.9, 0.1, 0.0])
    _, r = sums_of(table, rate, 3)
    scale = np.maximum(np.maximum(before, wanted), 1)
    slope = mixing.EASE * tokens * (np.array(r) - 1) + tokens * (p @ (((tokens * r) @ p - wanted) / scale))
    assert np.all(np.where(np.array(r) > 0, np.abs(slope), np.minimum(slope, 0)) < 1e-3 * tokens)

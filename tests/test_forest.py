"""The forest whose trees stay on the executors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriflume.operators import forest


def rows(n=1_200, p=6):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, p))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, 0.0) + 0.1 * rng.standard_normal(n)
    return x, y


@pytest.mark.parametrize("local", [20_000, 150])
def test_forest_in_units(spark, local):
    """The driver holds upper nodes by rows over `local`, never those below; trees cover their bootstraps and predict."""
    x, y = rows()
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, label double")
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    fit = lambda t: forest.fit(t, float(y[np.arange(len(y)) % 4 > 0].mean()), float(y.std()), trees=12, local=local)
    f = fit(train)
    below = f.units.select(F.sum(F.size("left"))).first()[0]
    held = sum(len(t["left"]) for t in f.upper)
    assert below > 12 * 300 and held <= (12 if local > 900 else 12 * 2 * 900 / 150 * 3) and (held > 12) == (local < 900)
    got = {r["id"]: (r["prediction"], r["spread"]) for r in f.predict(test).collect()}
    ids = np.array(sorted(got))
    p = np.array([got[i][0] for i in ids])
    assert len(ids) == 300 and 1 - ((p - y[ids]) ** 2).sum() / ((y[ids] - y[ids].mean()) ** 2).sum() > 0.85
    each = []
    for feature, threshold, left, right, value in f.trees():
        out = []
        for v in x[ids]:
            at = 0
            while left[at] >= 0:
                at = left[at] if v[feature[at]] <= threshold[at] else right[at]
            out.append(value[at])
        each.append(out)
    assert np.allclose(np.mean(each, 0), p) and np.allclose(np.std(each, 0), [got[i][1] for i in ids])
    assert abs(sum(f.importances) - 1) < 1e-9 and np.argsort(f.importances)[::-1][:2].tolist() == [0, 1]
    again = {r["id"]: (r["prediction"], r["spread"]) for r in fit(train.orderBy(F.desc("label")).repartition(7)).predict(test.repartition(5)).collect()}
    assert again == got  # neither order nor partitions count


def test_a_tree_against_a_plain_one():
    """grow() splits where the variance falls most, and leaves hold the means of at least two draws."""
    rng = np.random.default_rng(2)
    codes, q = rng.integers(0, 8, (60, 3)).astype(np.uint8), rng.integers(-50, 50, 60).astype(float)
    w = rng.integers(1, 3, 60).astype(float)
    g = forest.grow(codes, w, q, 30, 3, 2, np.random.default_rng(0))

    def check(node, mine):
        n, s = w[mine].sum(), (w * q)[mine].sum()
        assert (g["count"][node], g["total"][node]) == (n, s) and n >= 2
        found = 0.0
        for j in range(3):
            for b in range(7):
                side = codes[mine, j] <= b
                a, c = w[mine][side].sum(), w[mine][~side].sum()
                if min(a, c) >= 2:
                    found = max(found, (w * q)[mine][side].sum() ** 2 / a + (w * q)[mine][~side].sum() ** 2 / c - s * s / n)
        if g["left"][node] < 0:
            assert found <= 1e-9 * (s * s / n + 1)
            return
        assert abs(g["gain"][node] - found) < 1e-6 * (found + 1)
        side = codes[mine, g["feature"][node]] <= g["bin"][node]
        check(g["left"][node], mine[side])
        check(g["right"][node], mine[~side])

    check(0, np.arange(60))

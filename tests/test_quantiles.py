"""Percentiles by selection against numpy, whatever the sketches' accuracy and how alike the values are."""

import numpy as np
import pytest

from veriflume.operators.quantiles import percentiles

P = [0.0, 0.05, 0.25, 0.5, 0.751, 1.0]


@pytest.mark.parametrize("fetch, accuracy", [(20_000, 10_000), (40, 100), (3, 10), (0, 20)])
def test_percentiles_against_numpy(spark, fetch, accuracy):
    rng = np.random.default_rng(fetch)
    n = 600
    a, b = rng.normal(size=n), np.where(rng.random(n) < 0.6, 7.0, rng.integers(0, 9, n) * 1e300)
    g = rng.choice(["x", "y", None], n, p=[0.7, 0.2, 0.1])
    c = np.where(rng.random(n) < 0.3, np.nan, rng.integers(-3, 4, n))
    rows = [(g[i], float(a[i]), float(b[i]), None if i % 11 == 0 else float(c[i])) for i in range(n)] + [("empty", None, None, float("nan"))]
    df = spark.createDataFrame(rows, "arm string, a double, b double, c double")
    columns = {"a": a, "b": b, "c": np.where(np.arange(n) % 11 == 0, np.nan, c)}
    for by in (None, "arm"):
        got = {(r["arm"] if by else "all", r["column"]): (r["n"], r["values"]) for r in percentiles(df, list(columns), P, by, fetch, accuracy).collect()}
        for arm in ["x", "y", None, "empty"] if by else ["all"]:
            for name, v in columns.items():
                v = v[~np.isnan(v) & (np.array([x == arm for x in g]) if by else True)]
                assert got[arm, name][0] == len(v)
                if len(v):
                    assert np.allclose(got[arm, name][1], np.quantile(v, P), rtol=1e-12, atol=0), (arm, name)
                else:
                    assert got[arm, name][1] == [None] * len(P)


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "arm string, a double")
    assert [tuple(r) for r in percentiles(none, ["a"], [0.5]).collect()] == [("a", 0, [None])]
    assert percentiles(none, ["a"], [0.5], "arm").count() == 0

"""Draws by chunk, merged states and interval bundles against loops over the drawn rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriflume.operators import bootstrap, ranking


@pytest.mark.parametrize("size", [bootstrap.CHUNK, 7, 64])
def test_draws_add_up_whatever_the_chunks(size):
    n, reps = 150, np.arange(300)
    parts = [bootstrap.in_chunk(3, reps, c, n, size) for c in range(-(-n // size))]
    assert (sum(parts) == n).all()
    t = np.hstack([bootstrap.times(3, reps, c, n, min(size, n - c * size), size) for c in range(len(parts))])
    assert t.shape == (300, n) and (t.sum(1) == n).all()
    # each row is drawn once on average, with the variance of a binomial
    assert abs(t.mean() - 1) < 1e-9 and abs(t.var() - (1 - 1 / n)) < 0.05 and abs(t.mean(0) - 1).max() < 5 / math.sqrt(300)
    assert (np.hstack([bootstrap.times(3, reps[40:60], c, n, min(size, n - c * size), size) for c in range(len(parts))]) == t[40:60]).all()  # the units of a chunk may differ
    assert not (t == np.hstack([bootstrap.times(4, reps, c, n, min(size, n - c * size), size) for c in range(len(parts))])).all()


def drawn(n, resamples, seed, size):
    return np.hstack([bootstrap.times(seed, np.arange(resamples), c, n, min(size, n - c * size), size) for c in range(-(-n // size))])


@pytest.mark.parametrize("size", [bootstrap.CHUNK, 10])
def test_states_against_drawn_rows(spark, size):
    rng = random.Random(size)
    rows = [(i, int(rng.random() < 0.3), float(rng.choice([0, 1, 1, 1, 2, 3, 4]))) for i in range(95)]  # a third of the rows share a score
    df = spark.createDataFrame(rows, "seq long, label int, score double").repartition(5)
    reps = 140
    t = drawn(95, reps, 2, size)
    y, p = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    got = {r["rep"]: r for r in bootstrap.sums(df, ["label", "score"], reps, 2, size=size).collect()}
    assert sorted(got) == list(range(-1, reps)) and all(got[b]["n"] == 95 and got[b]["label"] == t[b] @ y and math.isclose(got[b]["score"], t[b] @ p) for b in range(reps))
    assert got[-1]["label"] == y.sum()
    some = bootstrap.resampled(df, reps, 2, size=size).groupBy("rep").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("score")).alias("s")).collect()
    assert all(r["n"] == 95 and math.isclose(r["s"], t[r["rep"]] @ p) for r in some) and len(some) == reps
    ranked = sorted(rows, key=lambda r: (r[2], r[0]))
    areas = {r["rep"]: r["auc"] for r in bootstrap.areas(df, reps, 2, size).collect()}
    for b in range(reps):
        a = [(r[2], k) for r, k in zip(ranked, t[b]) if r[1] == 1]
        d = [(r[2], k) for r, k in zip(ranked, t[b]) if r[1] == 0]
        wins = sum(k * m * (1.0 if x < z else 0.5 if x == z else 0.0) for x, k in a for z, m in d)
        assert math.isclose(areas[b], wins / (sum(k for _, k in a) * sum(k for _, k in d)))


def test_enrichment_of_one_class_and_of_few_rows(spark):
    one = spark.createDataFrame([(i, 1, float(i)) for i in range(5)], "seq long, label int, score double")
    got = ranking.analyse_enrichment(one, 50).first()
    assert got["n_decoys"] == 0 and got["auc"] is None and got["bedroc"] is None and got["verdict"] == "inconclusive" and got["compounds_needed"] is None
    best = spark.createDataFrame([(i, int(i < 40), float(i)) for i in range(160)], "seq long, label int, score double")
    got = ranking.analyse_enrichment(best, 100, gap_warning="unmatched").first()
    assert (got["auc"], got["auc_low"], got["verdict"], got["ef1"], got["max_ef1"], got["gap_warning"]) == (1.0, 1.0, "separates", 4.0, 4.0, "unmatched")
    with pytest.raises(ValueError):
        bootstrap.areas(best.limit(2), 10)


def test_intervals_cover_the_truth(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=400)
    p = y + rng.normal(size=400) * 0.5
    got = {r["metric"]: r for r in ranking.evaluate(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "seq long, y double, p double"), 300).collect()}
    assert all(r["low"] < r["estimate"] < r["high"] and r["defined"] == 300 for r in got.values())
    assert math.isclose(got["rmse"]["estimate"], math.sqrt(((y - p) ** 2).mean())) and got["rmse"]["low"] < 0.5 < got["rmse"]["high"]


def test_ranks_of_resamples_take_one_exchange(spark):
    """Ranks of two values, and the sums over them, need the drawn rows exchanged once; no join by value, which a small file on disk would make a broadcast."""
    from pyspark.sql import functions as F

    from veriflume.operators import ranking

    rows = [(r, t, y, p) for r in (0, 1) for t, y, p in ((2, 1.0, 5.0), (1, 1.0, 4.0), (3, 0.5, 5.0), (1, 7.0, 6.0))]
    drawn = spark.createDataFrame(rows, "rep long, times long, y double, p double").repartition("rep")
    out = ranking.weighted_ranks(ranking.weighted_ranks(drawn, "y", "a"), "p", "b")
    got = {(r["y"], r["p"]): (r["a"], r["b"]) for r in out.where("rep = 1").collect()}
    assert got == {(1.0, 5.0): (5.0, 4.0), (1.0, 4.0): (5.0, 1.0), (0.5, 5.0): (2.0, 4.0), (7.0, 6.0): (7.0, 7.0)}
    plan = out.groupBy("rep").agg(F.sum("a"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan

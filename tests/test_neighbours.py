"""Index joins of fingerprints, nearest-neighbour joins and greedy choices against loops; what they meet is counted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriflume.operators import bitindex, similarity

FP = "id long, words array<long>"


def fingerprints(rng, n, width=32, sparse=True):
    """Bits by a skewed law: a few in nearly all rows, most in very few; a third of the rows are near copies, some are copies."""
    weights = [1 / (1 + i) ** (0.9 if sparse else 0.0) for i in range(64 * width)]
    order = list(range(64 * width))
    rng.shuffle(order)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.33:
            bits = set(rng.choice(rows[-8:])[1])
            for b in rng.choices(order, k=rng.choice([0, 1, 2])):
                bits ^= {b}
        else:
            bits = set(rng.choices(order, weights, k=rng.randint(0, 60 if sparse else 40 * width)))
        rows.append((i, bits))
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    return rows, [(i, [signed(sum(1 << (b - 64 * w) for b in bits if b // 64 == w)) for w in range(width)]) for i, bits in rows]


def likeness(x, y):
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("sparse, block", [(True, 2048), (True, 16), (False, 32)])
@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_pairs_against_all_pairs(spark, monkeypatch, sparse, block, threshold):
    monkeypatch.setattr(bitindex, "BLOCK", block)
    bits, rows = fingerprints(random.Random(7), 220, sparse=sparse)
    want = {(a, b): likeness(x, y) for a, x in bits for b, y in bits if a < b and x and y and likeness(x, y) >= threshold}
    met = spark.sparkContext.accumulator(0)
    got = bitindex.similar(spark.createDataFrame(rows, FP), threshold, met).collect()
    assert {(r["a"], r["b"]): pytest.approx(r["similarity"]) for r in got} == want and len(got) == len(want) > 0
    assert met.value < 0.1 * 220 * 219 / 2 or not sparse, met.value


@pytest.mark.parametrize("width, sparse", [(1, True), (1, False), (2, False)])
def test_narrow_fingerprints_are_counted_in_strips(spark, monkeypatch, width, sparse):
    """A unit's pairs are strips of counts."""
    asked = bitindex.FEW_WORDS
    assert width <= asked
    monkeypatch.setattr(bitindex, "BLOCK", 64)
    monkeypatch.setattr(bitindex, "STRIP", 16)
    bits, rows = fingerprints(random.Random(11), 200, width=width, sparse=sparse)
    for threshold in (0.45, 0.7, 1.0):
        want = {(a, b): likeness(x, y) for a, x in bits for b, y in bits if a < b and x and y and likeness(x, y) >= threshold}
        got = bitindex.similar(spark.createDataFrame(rows, FP), threshold).collect()
        assert {(r["a"], r["b"]): pytest.approx(r["similarity"]) for r in got} == want and len(got) == len(want) > 0
    one = dict(bits)[7]
    word = [int(w) for w in dict(rows)[7]]
    said = {r["id"]: r["s"] for r in spark.createDataFrame(rows, FP).select("id", similarity.likeness(F.col("words"), word).alias("s")).collect()}
    assert all(abs(said[i] - likeness(x, one)) < 1e-12 for i, x in bits)


def test_a_pinned_structure_takes_no_pairs(spark, monkeypatch):
    from veriflume.operators import generation

    calls, plain = [], similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda *a: calls.append(1) or plain(*a))
    df = spark.createDataFrame([(i, 25, 1.0, w, w.bit_count()) for i, w in enumerate([7, 3, 56, 24, 7 << 20])], "id long, heavy_atoms int, resolution double, word long, bits long")
    assert sorted(r["id"] for r in generation.select_diverse(df, pinned=3).collect()) == [0, 3, 4] and len(calls) == 1


def test_copies_of_a_molecule_are_taken_apart_once(spark):
    from veriflume.operators import generation

    met = generation.fragments(spark.createDataFrame([("CCc1ccccc1",)] * 50, "smiles string"))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    below = plan[max(plan.rfind("ArrowEvalPython"), plan.rfind("BatchEvalPython")):]
    assert "Aggregate" in below and met.count() == generation.fragments(spark.createDataFrame([("CCc1ccccc1",)], "smiles string")).count() > 0


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("sparse, block, few", [(True, 2048, 0), (True, 16, 0), (False, 32, 0), (True, 2048, 1000)])
def test_nearest_against_all_pairs(spark, monkeypatch, sparse, block, few, own):
    monkeypatch.setattr(bitindex, "BLOCK", block)
    bits, rows = fingerprints(random.Random(3), 260, sparse=sparse)
    left, right = rows, rows if own else rows[::3]
    refs = [b for b in bits if own or b[0] % 3 == 0]
    want = {i: max(((likeness(x, y), -r) for r, y in refs if not (own and r == i))) for i, x in bits}
    met = spark.sparkContext.accumulator(0)
    got = {r["id"]: (r["similarity"], -r["ref"]) for r in bitindex.nearest(spark.createDataFrame(left, FP), spark.createDataFrame(right, FP), own, met, few).collect()}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-12 for i in want)
    if sparse and not few:
        assert met.value < len(left) * len(right), met.value  # two thirds of the rows are like nothing, and must look far


def test_nearest_of_near_copies_meets_few(spark):
    bits, rows = fingerprints(random.Random(4), 300)
    df = spark.createDataFrame(rows, FP)
    met = spark.sparkContext.accumulator(0)
    got = bitindex.nearest(df, df, met=met, broadcast_rows=0).collect()  # an empty one has the first for its nearest, at 0
    assert len(got) == 300 and sum(r["similarity"] == 1 for r in got) == sum(bool(x) for _, x in bits) and all(r["ref"] == 0 for r in got if not r["similarity"])
    assert met.value < 0.1 * 300 * 300, met.value


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], FP)
    one = spark.createDataFrame([(1, [0, 0])], FP)
    assert bitindex.similar(none, 0.5).count() == bitindex.similar(one, 0.5).count() == 0
    for few in (0, 10):
        assert bitindex.nearest(none, one, broadcast_rows=few).count() == bitindex.nearest(one, none, broadcast_rows=few).count() == bitindex.nearest(one, one, True, broadcast_rows=few).count() == 0
        assert [tuple(r) for r in bitindex.nearest(one, one, broadcast_rows=few).collect()] == [(1, 1, 0.0)]


def greedy(n, edges):
    near = {}
    for a, b in edges:
        near.setdefault(max(a, b), set()).add(min(a, b))
    kept = set()
    for i in range(n):
        if not near.get(i, set()) & kept:
            kept.add(i)
    return kept


@pytest.mark.parametrize("cell", [500_000, 100, 7])
def test_first_independent_against_a_loop(spark, cell):
    rng = random.Random(cell)
    n = 150
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(300)) if a < b} | {(3, b) for b in range(60, 150)}
    ids = spark.range(n)
    got = {r["id"] for r in similarity.first_independent(ids, spark.createDataFrame([*edges, (5, 5), (1, 2), (1, 2)], "a long, b long"), cell).collect()}
    assert got == greedy(n, edges | {(1, 2)})


def test_long_chains_settle(spark):
    n = 10_000
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = sorted(r["id"] for r in similarity.first_independent(spark.range(n), chain).collect())
    assert got == list(range(0, n, 2))
    assert similarity.first_independent(spark.range(n), chain, 2_000).count() == n // 2
    assert similarity.first_independent(spark.range(5), chain.where("false")).count() == 5


def test_diverse_subset_with_copies(spark):
    bits, _ = fingerprints(random.Random(5), 200, width=1)
    word = lambda x: (w := sum(1 << b for b in x)) - ((w >> 63) << 64)
    rows = [(i, word(x), len(x)) for i, x in bits] + [(900, None, None), (901, word(bits[0][1]), len(bits[0][1]))]
    kept = []
    for i, x in [*bits, (901, bits[0][1])]:
        if not any(likeness(x, y) >= 0.6 for _, y in kept):
            kept.append((i, x))
    got = {r["id"] for r in similarity.diverse_subset(spark.createDataFrame(rows, "id long, word long, bits long"), 0.6).collect()}
    assert got == {i for i, _ in kept}


# ---------------------------------------------------------------- vectors

VEC = "id long, features array<double>"


def clustered(rng, n, dim=6, clusters=12):
    centres = rng.normal(size=(clusters, dim)) * 10
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.3
    x[n // 2 :: 7] = x[0]  # copies, with ties
    return x.round(3)


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("k, block, broadcast", [(1, 2048, 0), (5, 16, 0), (5, 2048, 10**9), (400, 64, 0)])
def test_nearest_vectors_against_all_pairs(spark, k, block, broadcast, own):
    rng = np.random.default_rng(k)
    x = clustered(rng, 300)
    y = x if own else clustered(rng, 250)
    rows = lambda v: [(i, r.tolist()) for i, r in enumerate(v)] + [(9000, None)]
    met = spark.sparkContext.accumulator(0)
    from veriflume.operators import knn

    got = {r["id"]: [(n["d"], n["ref"]) for n in r["near"]] for r in knn.nearest(spark.createDataFrame(rows(x), VEC), spark.createDataFrame(rows(y), VEC), k, exclude_self=own, met=met, broadcast_numbers=broadcast, block=block).collect()}
    for i, v in enumerate(x):
        d = np.sqrt(((v - y) ** 2).sum(1))
        want = sorted((float(z), j) for j, z in enumerate(d) if not (own and i == j))[:k]
        assert [j for _, j in got[i]] == [j for _, j in want] and np.allclose([z for z, _ in got[i]], [z for z, _ in want])
    assert len(got) == 300
    if k <= 5 and not broadcast and own:
        assert met.value < 0.35 * len(x) * len(y), met.value


def test_wide_rows_meet_large_blocks(spark, monkeypatch):
    """In many dimensions no cell is ruled out: rows go to a few large blocks, not to every cell, and answers stay exact."""
    from veriflume.operators import knn

    monkeypatch.setattr(knn, "CHUNK", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 40)).round(2)
    x[200:] = x[:100]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    sent, plain = [], knn._in_blocks
    monkeypatch.setattr(knn, "_in_blocks", lambda *a: sent.append(a[0].count()) or plain(*a))
    for own in (True, False):
        got = {r["id"]: [(n["d"], n["ref"]) for n in r["near"]] for r in knn.nearest(rows, rows, 3, exclude_self=own, broadcast_numbers=0, wide=0, large=128).collect()}
        for i, v in enumerate(x):
            d = np.sqrt(((v - x) ** 2).sum(1))
            want = sorted((float(z), j) for j, z in enumerate(d) if not (own and i == j))[:3]
            assert [j for _, j in got[i]] == [j for _, j in want] and np.allclose([z for z, _ in got[i]], [z for z, _ in want])
    assert len(sent) == 2 and sent[0] > 100


def test_memory_of_a_broadcast_side():
    """Distances to all rows of the right side never stand at once."""
    import tracemalloc

    from veriflume.operators import knn

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(256, 4)), rng.normal(size=(200_000, 4))
    tracemalloc.start()
    knn._top(np.arange(256), x, np.arange(len(y)), y, 1, False)
    assert tracemalloc.get_traced_memory()[1] < 100e6  # all at once are 410 MB
    tracemalloc.stop()


def test_nearest_vectors_of_nothing(spark):
    from veriflume.operators import knn

    one, none = spark.createDataFrame([(1, [0.0, 1.0])], VEC), spark.createDataFrame([], VEC)
    for b in (0, 100):
        assert knn.nearest(none, one, 2, broadcast_numbers=b).count() == knn.nearest(one, none, 2, broadcast_numbers=b).count() == 0
        assert [len(r["near"]) for r in knn.nearest(one, one, 2, exclude_self=True, broadcast_numbers=b).collect()] in ([0], [])
        assert knn.nearest(one, one, 2, broadcast_numbers=b).first()["near"][0]["d"] == 0

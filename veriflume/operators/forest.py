"""Random forests whose trees never meet in one place: upper levels from summed histograms, what hangs below them task by task.

A tree is grown level by level from histograms that tasks sum over their rows, until a node holds no more than LOCAL rows of its
bootstrap sample; then these rows meet in one task, which grows the rest. The driver keeps the upper nodes, about two for each
LOCAL rows and tree; all other nodes stay in a table (tree, unit, arrays of nodes), which predictions join unit by unit. Features are
exchanged as bins, a byte each. Bootstrap weights are counter hashes of ids, and labels are summed as whole numbers, so
neither the order of rows nor their partitions change a tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: bins of a feature, rows of a node that one task grows on, rows of which thresholds are quantiles (as many as Spark's own trees take), rows of a prediction unit
BINS, LOCAL, SAMPLE, BLOCK = 32, 20_000, 10_000, 20_000
#: labels are summed as whole numbers of this part of their spread, exactly while sums stay under 2^53
PART = 1 << 26
#: how often a bootstrap draws a row: 0, 1, ..
DRAWS = np.cumsum([exp(-1) / factorial(k) for k in range(12)])
UNITS = "tree int, unit int, feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>, gain array<double>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(h: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree's bootstrap draws each row."""
    u = _mixed(h.view(np.uint64) ^ _mixed(np.array([tree], np.uint64))) >> np.uint64(11)
    return np.searchsorted(DRAWS, u.astype(float) / float(1 << 53), side="right")


def _picked(rng, k: int, p: int, m: int) -> np.ndarray:
    """m of p features for each of k nodes."""
    return np.sort(np.argsort(rng.random((k, p)), axis=1)[:, :m], axis=1)


def _at_node(seed: int, tree: int, node: int, p: int, m: int) -> np.ndarray:
    return _picked(np.random.default_rng([seed, tree, node, 1]), 1, p, m)[0]


def best_splits(c: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(feature's place, bin, gain, count left, sum left) of nodes with histograms [node, feature, bin] of counts and label sums; no gain: none."""
    cl, sl = c.cumsum(2), s.cumsum(2)
    ct, st = cl[:, :1, -1:], sl[:, :1, -1:]
    cl, sl = cl[:, :, :-1], sl[:, :, :-1]
    cr, sr = ct - cl, st - sl
    whole = st * st / np.maximum(ct, 1)
    score = np.where((cl >= least) & (cr >= least), sl * sl / np.maximum(cl, 1) + sr * sr / np.maximum(cr, 1) - whole, -np.inf).reshape(len(c), -1)
    at = score.argmax(1)
    k, gain = np.arange(len(c)), score[np.arange(len(c)), at]
    gain = np.where(gain > 1e-12 * (whole[:, 0, 0] + 1), gain, 0.0)
    return at // cl.shape[2], at % cl.shape[2], gain, cl.reshape(len(c), -1)[k, at], sl.reshape(len(c), -1)[k, at]


def grow(codes: np.ndarray, w: np.ndarray, q: np.ndarray, depth: int, m: int, least: int, rng) -> dict[str, np.ndarray]:
    """A tree of rows of bins, all nodes of a level at once: feature, bin (left if no larger), left, right, count, total, gain; -1 at leaves."""
    p = codes.shape[1]
    out = {"feature": [-1], "bin": [-1], "left": [-1], "right": [-1], "count": [float(w.sum())], "total": [float((w * q).sum())], "gain": [0.0]}
    parts, made = [{k: np.array(v) for k, v in out.items()}], 1
    rows, node, last = np.arange(len(codes)), np.zeros(len(codes), np.int64), parts[0]
    live = np.flatnonzero(last["count"] >= 2 * least)
    rows, node = (rows, node) if len(live) else (rows[:0], node[:0])
    for _ in range(depth):
        if not len(live):
            break
        pick, width = _picked(rng, len(live), p, m), len(live) * m * BINS
        cell = ((node[:, None] * m + np.arange(m)) * BINS + codes[rows[:, None], pick[node]]).ravel()
        c = np.bincount(cell, np.repeat(w[rows], m), width).reshape(-1, m, BINS)
        s = np.bincount(cell, np.repeat(w[rows] * q[rows], m), width).reshape(-1, m, BINS)
        place, at, gain, cl, sl = best_splits(c, s, least)
        split = gain > 0
        k = int(split.sum())
        if not k:
            break
        f = pick[np.arange(len(live)), place]
        mine = live[split]
        last["feature"][mine], last["bin"][mine], last["gain"][mine] = f[split], at[split], gain[split]
        last["left"][mine] = made + 2 * np.arange(k)
        last["right"][mine] = last["left"][mine] + 1
        count, total = np.empty(2 * k), np.empty(2 * k)
        count[0::2], total[0::2] = cl[split], sl[split]
        count[1::2], total[1::2] = last["count"][mine] - cl[split], last["total"][mine] - sl[split]
        stays = split[node]
        rows, node = rows[stays], node[stays]
        node = 2 * (np.cumsum(split) - 1)[node] + (codes[rows, f[node]] > at[node])
        none = np.full(2 * k, -1)
        last = {"feature": none.copy(), "bin": none.copy(), "left": none.copy(), "right": none.copy(), "count": count, "total": total, "gain": np.zeros(2 * k)}
        parts.append(last)
        made += 2 * k
        wide = count >= 2 * least
        live = np.flatnonzero(wide)
        rows, node = rows[wide[node]], (np.cumsum(wide) - 1)[node[wide[node]]]
    return {k: np.concatenate([x[k] for x in parts]) for k in out}


def _descend(codes: np.ndarray, feature, bin_, left, right) -> np.ndarray:
    """The leaf of every row of bins."""
    at = np.zeros(len(codes), np.int64)
    rows = np.arange(len(codes))
    while len(rows := rows[left[at[rows]] >= 0]):
        k = at[rows]
        at[rows] = np.where(codes[rows, feature[k]] <= bin_[k], left[k], right[k])
    return at


def _codes(features, cuts: list[np.ndarray]) -> np.ndarray:
    x = np.stack(features).astype(float)
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _unpacked(col, p: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, p)


@dataclass
class Forest:
    """A fitted forest: thresholds of bins, the upper nodes of every tree (leaf: the number of its unit), and the units' table."""

    cuts: list[np.ndarray]
    upper: list[dict[str, list]]
    units: DataFrame
    importances: list[float] = field(default_factory=list)

    @property
    def n_units(self) -> int:
        return max(sum(x < 0 for x in t["left"]) for t in self.upper)

    def _routed(self, rows: DataFrame, blocks: int) -> DataFrame:
        """(tree, unit, block, row, codes): every row (row, features) once a tree."""
        shared = rows.sparkSession.sparkContext.broadcast((self.cuts, [{k: np.array(v) for k, v in t.items()} for t in self.upper]))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cuts, trees = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                codes = _codes(pdf["features"], cuts)
                packed, row = [x.tobytes() for x in codes], pdf["row"].to_numpy()
                for t, tree in enumerate(trees):
                    leaf = _descend(codes, tree["feature"], tree["bin"], tree["left"], tree["right"])
                    yield pd.DataFrame({"tree": t, "unit": tree["unit"][leaf], "block": row % blocks, "row": row, "codes": packed})

        return rows.select("row", "features").mapInPandas(route, "tree int, unit int, block int, row long, codes binary")

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (features, ..) with prediction, the trees' mean, and spread, their population standard deviation."""
        p, given = len(self.cuts), cut(rows.withColumn("__row", F.monotonically_increasing_id()))
        blocks = max(1, ceil(given.count() / (BLOCK * self.n_units)))
        numbered = given.select(F.col("__row").alias("row"), "features")
        mine = self.units.select("tree", "unit", "feature", "bin", "left", "right", "value").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["tree", "unit", "block"]

        def unit(nodes: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
            if not len(met):
                return pd.DataFrame({"row": np.empty(0, np.int64), "tree": np.empty(0, np.int32), "value": np.empty(0)})
            n = nodes.iloc[0]
            leaf = _descend(_unpacked(met["codes"], p), *[np.asarray(n[c]) for c in ("feature", "bin", "left", "right")])
            return pd.DataFrame({"row": met["row"], "tree": met["tree"], "value": np.asarray(n["value"])[leaf]})

        each = mine.groupBy(*key).cogroup(self._routed(numbered, blocks).groupBy(*key)).applyInPandas(unit, "row long, tree int, value double")
        per = each.groupBy(F.col("row").alias("__row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "value"))), lambda x: x["value"]).alias("v"))  # a number a tree
        mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
        per = per.withColumn("prediction", mean)
        gap = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("prediction")) * (x - F.col("prediction"))) / F.size("v")
        return given.join(per.select("__row", "prediction", F.sqrt(gap).alias("spread")), "__row").drop("__row")

    def trees(self) -> list[tuple[np.ndarray, ...]]:
        """(feature, threshold, left, right, prediction) arrays of every tree, on the driver: as large as the model, for looking at a small one."""
        units = {(r["tree"], r["unit"]): r for r in self.units.collect()}
        out = []
        for t, tree in enumerate(self.upper):
            cols = {"feature": list(tree["feature"]), "bin": list(tree["bin"]), "left": list(tree["left"]), "right": list(tree["right"]), "value": [0.0] * len(tree["left"])}
            for leaf in [i for i, x in enumerate(tree["left"]) if x < 0]:
                u, base = units[(t, tree["unit"][leaf])], len(cols["left"])
                for c in cols:
                    v = [x + base - 1 if c in ("left", "right") and x >= 0 else x for x in u[c]]  # a unit's root takes the place of the leaf
                    cols[c][leaf] = v[0]
                    cols[c] += v[1:]
            threshold = [self.cuts[f][b] if f >= 0 else 0.0 for f, b in zip(cols["feature"], cols["bin"])]
            out.append((np.array(cols["feature"]), np.array(threshold), np.array(cols["left"]), np.array(cols["right"]), np.array(cols["value"])))
        return out

    def save(self, path: str) -> None:
        self.units.write.parquet(f"{path}/units")
        kept = json.dumps({"cuts": [c.tolist() for c in self.cuts], "upper": self.upper, "importances": self.importances})
        self.units.sparkSession.createDataFrame([(kept,)], "fitted string").coalesce(1).write.parquet(f"{path}/fitted")

    @classmethod
    def load(cls, path: str) -> Forest:
        spark = SparkSession.active()
        kept = json.loads(spark.read.parquet(f"{path}/fitted").first()["fitted"])
        return cls([np.array(c) for c in kept["cuts"]], kept["upper"], spark.read.parquet(f"{path}/units"), kept["importances"])


def thresholds(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Per feature up to bins - 1 thresholds: quantiles of the rows first by a hash of their ids. They bound the splits that may be chosen; all rows choose."""
    few = np.stack(rows.orderBy("h", "label").limit(SAMPLE).select("features").toPandas()["features"]).astype(float)  # a bounded top-k
    out = []
    for x in few.T:
        values = np.unique(x)
        middles = (values[:-1] + values[1:]) / 2
        out.append(middles if len(middles) < bins else np.unique(np.quantile(x, np.arange(1, bins) / bins)))
    return out


def fit(train: DataFrame, label_mean: float, label_std: float, trees: int = 500, depth: int = 30, least: int = 2, seed: int = 0, local: int | None = None) -> Forest:
    """A forest of rows (id, features, label): Poisson bootstraps, the square root of all features at every node, splits that reduce variance most."""
    spark, local = train.sparkSession, local or LOCAL
    key = ["id"] if "id" in train.columns else ["features", "label"]
    rows = train.select(F.xxhash64(*key, F.lit(seed)).alias("h"), F.col("label").cast("double").alias("label"), "features")
    cuts = thresholds(rows)
    p = len(cuts)
    m, scale = ceil(p**0.5), PART / label_std
    shared = spark.sparkContext.broadcast(cuts)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"h": pdf["h"], "q": np.rint((pdf["label"] - label_mean) * scale), "codes": [x.tobytes() for x in _codes(pdf["features"], shared.value)]})

    data = cut(rows.mapInPandas(binned, "h long, q double, codes binary"))
    upper = [{"feature": [-1], "bin": [-1], "left": [-1], "right": [-1], "gain": [0.0], "count": [0.0], "total": [0.0], "level": [0]} for _ in range(trees)]
    live = [(t, 0) for t in range(trees)] if data.count() > local else []
    closed: set[tuple[int, int]] = set()

    def arrays() -> list[dict[str, np.ndarray]]:
        return [{k: np.array(v) for k, v in t.items()} for t in upper]

    while live:
        state = spark.sparkContext.broadcast((arrays(), live))

        def summed(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            nodes, wanted = state.value
            of: dict[int, list[int]] = {}
            for t, n in wanted:
                of.setdefault(t, []).append(n)
            picks = {tn: _at_node(seed, *tn, p, m) for tn in wanted}
            held: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                codes, h, q = _unpacked(pdf["codes"], p), pdf["h"].to_numpy(), pdf["q"].to_numpy()
                for t, mine in of.items():
                    tree, w = nodes[t], drawn(h, t)
                    leaf = _descend(codes, tree["feature"], tree["bin"], tree["left"], tree["right"])
                    for n in mine:
                        at = np.flatnonzero((leaf == n) & (w > 0))
                        cell = (np.arange(m) * BINS + codes[at[:, None], picks[t, n]]).ravel()
                        got = np.stack([np.bincount(cell, np.repeat(x, m), m * BINS) for x in (w[at], w[at] * q[at])])
                        held[t, n] = held[t, n] + got if (t, n) in held else got
            if held:
                yield pd.DataFrame({"tree": [t for t, _ in held], "node": [n for _, n in held], "v": [x.ravel() for x in held.values()]})

        def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
            c, s = np.sum(np.stack(pdf["v"]), axis=0).reshape(2, 1, m, BINS)
            place, at, gain, cl, sl = best_splits(c, s, least)
            t, n = int(pdf["tree"].iat[0]), int(pdf["node"].iat[0])
            return pd.DataFrame({"tree": [t], "node": [n], "feature": _at_node(seed, t, n, p, m)[place], "bin": at, "gain": gain, "cl": cl, "sl": sl, "count": c[:, 0].sum(1), "total": s[:, 0].sum(1)})

        found = data.mapInPandas(summed, "tree int, node int, v array<double>").groupBy("tree", "node").applyInPandas(chosen, "tree int, node int, feature int, bin int, gain double, cl double, sl double, count double, total double").collect()  # a row a node of over `local` rows
        live = []
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            t, n = upper[r["tree"]], r["node"]
            t["count"][n], t["total"][n] = r["count"], r["total"]
            if r["count"] <= local and n == 0:
                continue
            if not r["gain"] > 0 or t["level"][n] == depth:
                closed.add((r["tree"], n))
                continue
            t["feature"][n], t["bin"][n], t["gain"][n], t["left"][n], t["right"][n] = r["feature"], r["bin"], r["gain"], len(t["left"]), len(t["left"]) + 1
            for count, total in ((r["cl"], r["sl"]), (r["count"] - r["cl"], r["total"] - r["sl"])):
                if count > local:
                    live.append((r["tree"], len(t["left"])))
                for k, v in (("feature", -1), ("bin", -1), ("left", -1), ("right", -1), ("gain", 0.0), ("count", count), ("total", total), ("level", t["level"][n] + 1)):
                    t[k].append(v)
    for t in upper:
        t["unit"] = [-1] * len(t["left"])
        for u, n in enumerate(i for i, x in enumerate(t["left"]) if x < 0):
            t["unit"][n] = u
    state = spark.sparkContext.broadcast((arrays(), closed))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, done = state.value
        for pdf in batches:
            if not len(pdf):
                continue
            packed, h, q = pdf["codes"].to_numpy(), pdf["h"].to_numpy(), pdf["q"].to_numpy()
            codes = _unpacked(packed, p)
            for t, tree in enumerate(nodes):
                w = drawn(h, t)
                leaf = _descend(codes, tree["feature"], tree["bin"], tree["left"], tree["right"])
                at = np.flatnonzero((w > 0) & ~np.isin(leaf, [n for u, n in done if u == t]))
                yield pd.DataFrame({"tree": t, "unit": tree["unit"][leaf[at]], "level": tree["level"][leaf[at]], "w": w[at], "q": q[at], "codes": packed[at]})

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        t, u = int(pdf["tree"].iat[0]), int(pdf["unit"].iat[0])
        g = grow(_unpacked(pdf["codes"], p), pdf["w"].to_numpy().astype(float), pdf["q"].to_numpy(), depth - int(pdf["level"].iat[0]), m, least, np.random.default_rng([seed, t, u, 0]))
        return pd.DataFrame({"tree": [t], "unit": [u], **{k: [g[k]] for k in ("feature", "bin", "left", "right")}, "value": [label_mean + g["total"] / np.maximum(g["count"], 1) / scale], "gain": [g["gain"]]})

    units = data.mapInPandas(dealt, "tree int, unit int, level int, w int, q double, codes binary").groupBy("tree", "unit").applyInPandas(subtree, UNITS)
    bare = [(t, upper[t]["unit"][n], [-1], [-1], [-1], [-1], [label_mean + upper[t]["total"][n] / max(upper[t]["count"][n], 1) / scale], [0.0]) for t, n in sorted(closed)]
    units = cut(units.unionByName(spark.createDataFrame(bare, UNITS)) if bare else units)
    above = [(t, f, g) for t, tree in enumerate(upper) for f, g in zip(tree["feature"], tree["gain"]) if f >= 0]
    per = units.select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("n")).select("tree", "n.feature", "n.gain").where("feature >= 0")
    per = per.unionByName(spark.createDataFrame(above, "tree int, feature int, gain double")) if above else per
    total = np.zeros((trees, p))
    for r in per.groupBy("tree", "feature").agg(F.sum("gain").alias("g")).collect():  # a row a tree and feature
        total[r["tree"], r["feature"]] = r["g"]
    each = (total / np.maximum(total.sum(1, keepdims=True), np.finfo(float).tiny)).sum(0)
    upper = [{k: t[k] for k in ("feature", "bin", "left", "right", "unit")} for t in upper]
    return Forest(cuts, upper, units, (each / max(each.sum(), np.finfo(float).tiny)).tolist())

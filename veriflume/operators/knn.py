"""Exact nearest-neighbour join of vectors by pivot cells and the triangle inequality.

A bounded sample of the right side serves as pivots, and every right row lies in the cell of its nearest pivot. A left row is first
compared with cells near it until they hold k rows, which bounds how far its k-th neighbour can be. In the second round it is
sent only to those cells that the triangle inequality does not rule out: a cell whose rows lie between `low` and `high` from its
pivot holds nothing nearer than d(row, pivot) - high or low - d(row, pivot), and nothing nearer than half the gap by which its
pivot is further than the row's nearest one. Cells are cut to blocks and pairs of blocks are units of their own, so a cell with
most of the rows fills many tasks. Distances come from differences, so that equal rows are exactly as far from anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import euclidean

#: rows of a block; pivots at most (a sample: what it is decides only how much is compared)
BLOCK, PIVOTS = 2048, 1024
#: numbers of a right side that is compared where the left rows are, without an exchange (16 MB)
BROADCAST_NUMBERS = 2_000_000
#: rows of a large block; rows of a strip and of a chunk that are compared at once; visits that a row may make without being wide
LARGE, STRIP, CHUNK, WIDE = 16_384, 256, 4096, 32
#: rows that a task takes, and pairs where the right side is broadcast
ROWS, PAIRS = 4096, 500_000_000
#: distances are sums of rounded squares: bounds give way by so much
SLACK = 1e-9


def _vectors(df: DataFrame, features: str) -> DataFrame:
    return df.where(F.col(features).isNotNull()).select("id", F.col(features).alias("features"))


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """rows for so many tasks: a few files hold more than a few tasks should compare."""
    return rows.repartition(max(1, min(tasks, 10_000)), "id")


def _top(ids, x: np.ndarray, refs: np.ndarray, y: np.ndarray, k: int, exclude_self: bool, met=None, bounds: np.ndarray | None = None) -> pd.DataFrame:
    """(id, near) of rows x among rows y, which come by refs; what lies beyond a row's bound may be left out."""
    near = []
    yy = np.einsum("ij,ij->i", y, y)
    longer = np.hstack([y, yy[:, None]])
    at_self = np.minimum(np.searchsorted(refs, ids), len(refs) - 1) if exclude_self and len(refs) else None
    for at in range(0, len(x), STRIP):
        a = x[at : at + STRIP]
        n, aa = len(a), np.einsum("ij,ij->i", a, a)
        left = np.hstack([-2 * a, np.ones((n, 1))])
        slack = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (aa + (yy.max() if len(yy) else 0))
        limit = np.full(n, np.inf) if bounds is None else (bounds[at : at + STRIP] * (1 + SLACK)) ** 2 + SLACK**2
        row, d, ref = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for to in range(0, len(y), CHUNK):
            part = left @ longer[to : to + CHUNK].T  # squared distances less the row's own square
            if at_self is not None:
                j = at_self[at : at + STRIP] - to
                i = np.flatnonzero((j >= 0) & (j < part.shape[1]) & (refs[at_self[at : at + STRIP]] == ids[at : at + STRIP]))
                part[i, j[i]] = np.inf
            open_ = np.flatnonzero(np.isinf(limit))
            top = np.where(np.isinf(limit), np.inf, limit - aa + slack)
            if len(open_) and part.shape[1] > k:
                top[open_] = np.partition(part[open_], k - 1, axis=1)[:, k - 1] + 2 * slack[open_]
            i, j = np.nonzero((part <= top[:, None]) & (part < np.inf))
            gap = a[i] - y[j + to]
            row, d, ref = np.concatenate([row, i]), np.concatenate([d, np.sqrt(np.einsum("ij,ij->i", gap, gap))]), np.concatenate([ref, j + to])
            order = np.lexsort((ref, d, row))
            row, d, ref = row[order], d[order], ref[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, d, ref, place = (v[place < k] for v in (row, d, ref, place))
            kth = place == k - 1
            limit[row[kth]] = np.minimum(limit[row[kth]], d[kth] ** 2)
        ends = np.searchsorted(row, np.arange(n + 1))
        d = d.tolist()
        near += [[{"d": d[i], "ref": refs[ref[i]]} for i in range(u, v)] for u, v in zip(ends[:-1], ends[1:])]
    if met is not None:
        met.add(len(x) * len(y))
    return pd.DataFrame({"id": ids, "near": near})


def _in_blocks(rows: DataFrame, right: DataFrame, k: int, exclude_self: bool, schema: str, met, size: int) -> DataFrame:
    """(id, near) of rows (id, features, bound) from every large block of the right side: k of each at most."""
    lkind, rkind = (df.schema["id"].dataType.simpleString() for df in (rows, right))
    nl, nr = (max(1, -(-df.count() // size)) for df in (rows, right))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    no = lambda kind: F.lit(None).cast(kind)
    a = rows.select(block(nl).alias("l"), F.col("id").alias("lid"), no(rkind).alias("rid"), "features", "bound").withColumn("r", every(nr))
    b = right.select(block(nr).alias("r"), no(lkind).alias("lid"), F.col("id").alias("rid"), "features", F.lit(0.0).alias("bound")).withColumn("l", every(nl))

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["rid"].isna()], pdf[pdf["rid"].notna()].sort_values("rid", kind="stable")
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "near": []}, dtype=object)
        whole = lambda c, kind: c.to_numpy(np.int64 if kind in ("int", "bigint") else object)  # noqa: E731  ids are null on the other side
        return _top(whole(x["lid"], lkind), np.stack(x["features"]).astype(float), whole(y["rid"], rkind), np.stack(y["features"]).astype(float), k, exclude_self, met, x["bound"].to_numpy())

    return a.unionByName(b).groupBy("l", "r").applyInPandas(unit, schema)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what units found: k of each at most."""
    return found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def nearest(left: DataFrame, right: DataFrame, k: int, features: str = "features", exclude_self: bool = False, met=None, broadcast_numbers: int = BROADCAST_NUMBERS, pivots: int = PIVOTS, block: int = BLOCK, wide: int = WIDE, large: int = LARGE) -> DataFrame:
    """(id, near): near holds (d, ref) of the k nearest right rows, ties by ref; fewer where there are fewer.

    features: a column of arrays of equal length; rows where it is NULL are left out on both sides. met: an accumulator of the pairs
    compared. wide: what a row may visit without being sent to large blocks. Ids of the right side are unique.
    """
    lkind, rkind = (df.schema["id"].dataType.simpleString() for df in (left, right))
    schema = f"id {lkind}, near array<struct<d: double, ref: {rkind}>>"
    l, r = _vectors(left, features), _vectors(right, features)
    s = r.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("p")).first()
    n, p = s["n"], s["p"] or 0
    if not n:
        return left.sparkSession.createDataFrame([], schema)
    sc = left.sparkSession.sparkContext
    many = l.count()
    if n * p <= broadcast_numbers:
        l = _dealt(l, max(-(-many // ROWS), many * n // PAIRS))
        few = r.toPandas().sort_values("id", kind="stable")
        shared = sc.broadcast((few["id"].to_numpy(), np.stack(few["features"]).astype(float)))

        def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield _top(pdf["id"].to_numpy(), np.stack(pdf["features"]).astype(float), *shared.value, k, exclude_self, met)

        return l.mapInPandas(here, schema)

    l, r = _dealt(l, -(-many // ROWS)), _dealt(r, -(-n // ROWS))
    wanted = min(pivots, max(1, int(np.sqrt(n))))
    picked = r.withColumn("h", F.xxhash64("id")).orderBy("h").limit(wanted).toPandas()  # a bounded top-k
    centres = np.unique(np.stack(picked["features"]).astype(float), axis=0)
    shared = sc.broadcast(centres)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = euclidean(np.stack(pdf["features"]).astype(float), shared.value)
                cell = d.argmin(1)
                yield pd.DataFrame({"id": pdf["id"], "features": pdf["features"], "cell": cell, "far": d[np.arange(len(d)), cell]})

    cells = cut(r.mapInPandas(placed, f"id {rkind}, features array<double>, cell long, far double"))
    stats = {x["cell"]: (x["n"], x["low"], x["high"]) for x in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}  # a row a pivot
    count = np.array([stats.get(c, (0, 0, 0))[0] for c in range(len(centres))])
    low, high = (np.array([stats.get(c, (0, np.inf, np.inf))[i] for c in range(len(centres))]) for i in (1, 2))
    blocks = np.maximum(1, -(-count // block))
    enough = k + exclude_self

    def homes(d: np.ndarray) -> np.ndarray:
        """The nearest cells of every row that hold enough rows together."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(count[order], axis=1) - count[order]
        mine = np.zeros(d.shape, bool)
        np.put_along_axis(mine, order, (before < enough) & (count[order] > 0), axis=1)
        return mine

    def others(d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        t = bound[:, None] + SLACK
        gap = np.maximum(np.maximum(d - high[None, :], low[None, :] - d), 0)
        # every row of a cell is no further from its pivot than from the left row's nearest one
        plane = (d - d.min(1)[:, None]) / 2
        return (np.maximum(gap, plane) <= t) & (count[None, :] > 0) & ~homes(d)

    def searched(rows: DataFrame, second: bool) -> DataFrame:
        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    d = euclidean(np.stack(part["features"]).astype(float), shared.value)
                    where, cell = np.nonzero(others(d, part["bound"].to_numpy()) if second else homes(d))
                    times = blocks[cell]
                    rep = np.repeat(np.arange(len(where)), times)
                    j = np.concatenate([np.arange(t) for t in times]) if len(times) else np.empty(0, np.int64)
                    i = part["h"].to_numpy()[where][rep]
                    rows_ = where[rep]
                    if len(rows_):
                        yield pd.DataFrame({"cell": cell[rep], "i": i, "j": j, "lid": part["id"].to_numpy()[rows_], "features": [part["features"].iat[x] for x in rows_]})

        visits = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
        return visits.mapInPandas(deal, f"cell long, i long, j long, lid {lkind}, features array<double>")

    def round_(rows: DataFrame, second: bool) -> DataFrame:
        visits = cut(searched(rows, second))
        load = {x["cell"]: max(1, -(-x["n"] // block)) for x in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
        if not load:
            return left.sparkSession.createDataFrame([], schema)
        spread = F.create_map(*[F.lit(x) for c, m in load.items() for x in (c, max(1, -(-m // int(blocks[c]))))])
        a = visits.withColumn("i", F.pmod("i", spread[F.col("cell")])).withColumn("rid", F.lit(None).cast(rkind))
        b = cells.withColumn("j", F.pmod(F.xxhash64("id"), F.element_at(F.lit(blocks.tolist()).cast("array<long>"), (F.col("cell") + 1).cast("int"))))
        b = b.withColumn("i", F.explode(F.sequence(F.lit(0), spread[F.col("cell")] - 1))).select("cell", "i", "j", F.lit(None).cast(lkind).alias("lid"), "features", F.col("id").alias("rid"))

        def unit(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = pdf[pdf["rid"].isna()], pdf[pdf["rid"].notna()].sort_values("rid", kind="stable")
            if not len(x) or not len(y):
                return pd.DataFrame({"id": [], "near": []}, dtype=object)
            whole = lambda c, kind: c.to_numpy(np.int64 if kind in ("int", "bigint") else object)  # noqa: E731  ids are null on the other side
            return _top(whole(x["lid"], lkind), np.stack(x["features"]).astype(float), whole(y["rid"], rkind), np.stack(y["features"]).astype(float), k, exclude_self, met)

        return _merged(a.unionByName(b).groupBy("cell", "i", "j").applyInPandas(unit, schema), k)

    first = cut(round_(l, False))
    kth = F.when(F.size("near") >= k, F.element_at("near.d", k)).otherwise(F.lit(float("inf")))  # fewer than k: everything may be nearer
    bounded = l.join(first.select("id", kth.alias("bound")), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                d = euclidean(np.stack(part["features"]).astype(float), shared.value)
                visits = others(d, part["bound"].to_numpy()) @ blocks
                yield part.assign(wide=(visits > wide) & (4 * visits > blocks.sum()))

    again = cut(bounded.mapInPandas(judged, f"id {lkind}, features array<double>, bound double, wide boolean"))
    far = again.where("wide").drop("wide")
    found = first.unionByName(round_(again.where("NOT wide").drop("wide"), True))
    return _merged(found if far.isEmpty() else found.unionByName(_in_blocks(far, r, k, exclude_self, schema, met, large)), k)

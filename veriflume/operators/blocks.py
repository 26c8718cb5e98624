"""All pairs of two tables, block against block, in numpy.

Both sides are dealt to blocks of about SIZE rows by the hash of their id; each pair of blocks is a unit of its own, so a task
holds two blocks and what it keeps of their pairs. What is exchanged is every row once for each block of the other side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, STRIP = 2048, 32


def block_pairs(left: DataFrame, right: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, size: int = SIZE) -> DataFrame:
    """f of every pair of a left and a right block; both sides have the same columns, id among them. Empty sides give nothing."""
    nl, nr = (max(1, -(-df.count() // size)) for df in (left, right))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumns({"__l": block(nl), "__side": F.lit(0)}).withColumn("__r", every(nr))
    b = right.withColumns({"__r": block(nr), "__side": F.lit(1)}).withColumn("__l", every(nl))

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["__side"].to_numpy()
        return f(pdf[side == 0].drop(columns=["__l", "__r", "__side"]), pdf[side == 1].drop(columns=["__l", "__r", "__side"]))

    return a.unionByName(b).groupBy("__l", "__r").applyInPandas(unit, schema)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y from their differences, so that equal rows are exactly as far from anything."""
    out = np.empty((len(x), len(y)))
    for at in range(0, len(x), STRIP):
        gap = x[at : at + STRIP, None, :] - y[None, :, :]
        out[at : at + STRIP] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def tanimoto(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities of all rows of packed words [n, words]; 0 for two empty ones."""
    shared = sum(np.bitwise_count(x[:, k, None] & y[None, :, k]).astype(np.int64) for k in range(x.shape[1]))
    a, b = (np.bitwise_count(z).sum(1).astype(np.int64) for z in (x, y))
    whole = a[:, None] + b[None, :] - shared
    return np.where(whole > 0, shared / np.maximum(whole, 1), 0.0)


def nearest(left: DataFrame, right: DataFrame, k: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], features: str = "features", exclude_self: bool = False, size: int = SIZE) -> DataFrame:
    """(id, near): near holds (d, ref) of the k right rows with the smallest measure, ties by ref; fewer where there are fewer.

    features: a column of arrays of equal length. Each unit keeps k of a row, so what meets in the end is k a block.
    """
    kind, ref = (df.schema["id"].dataType.simpleString() for df in (left, right))
    schema = f"id {kind}, near array<struct<d: double, ref: {ref}>>"

    def unit(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "near": []}, dtype=object)
        b = b.sort_values("id", kind="stable")
        d = measure(np.stack(a["features"]), np.stack(b["features"]))
        ids, refs = a["id"].to_numpy(), b["id"].to_numpy()
        if exclude_self:
            d = np.where(ids[:, None] == refs[None, :], np.inf, d)
        best = np.argsort(d, axis=1, kind="stable")[:, :k] if d.shape[1] <= 4 * k else _smallest(d, k)
        return pd.DataFrame({"id": ids, "near": [[{"d": float(d[i, j]), "ref": refs[j]} for j in row if np.isfinite(d[i, j])] for i, row in enumerate(best)]})

    cols = lambda df: df.where(F.col(features).isNotNull()).select("id", F.col(features).alias("features"))
    met = block_pairs(cols(left), cols(right), unit, schema, size)
    return met.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # k a block of the right side


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest of every row, ties by column."""
    bound = np.partition(d, k - 1, axis=1)[:, k - 1]
    return np.stack([(c := np.flatnonzero(row <= b))[np.argsort(row[c], kind="stable")[:k]] for row, b in zip(d, bound)])

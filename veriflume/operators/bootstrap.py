"""Bootstrap intervals at scale: draws are made where the rows are, and what meets is a state for each resample.

Rows have places in a fixed order and lie in chunks of consecutive places. How many of a resample's n draws fall into a chunk comes from
a tree of binomials over the chunks, each node of which any task can compute by itself; the draws inside a chunk come from a counter hash
of (seed, resample, chunk, draw). So a task makes the draws of its own chunk, in whatever order tasks run, and nothing of size rows x
resamples is exchanged. Sums merge by addition. The area under the ROC curve merges too, once it is known how many actives lie
before each chunk; scores that lie across chunks are put together by score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_total

#: rows of a chunk; resamples of a unit
CHUNK, REPS = 16_384, 125
MASK = np.uint64(0xFFFFFFFF)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 32-bit numbers, held in 64 bits."""
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x7FEB352D)) & MASK
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x846CA68B)) & MASK
    return x ^ (x >> np.uint64(16))


def mix32_sql(x: str, out: str) -> str:
    """The same as SELECT items of DuckDB, from a column to a column: each item may use those before it."""
    return f"xor({x}, {x} >> 16) * 2146121005 & 4294967295 AS {out}1, xor({out}1, {out}1 >> 15) * 2221713035 & 4294967295 AS {out}2, xor({out}2, {out}2 >> 16) AS {out}"


def in_chunk(seed: int, reps: np.ndarray, chunk: int, n: int, size: int = CHUNK) -> np.ndarray:
    """How many of the n draws of each resample fall into a chunk."""
    lo, hi, left = 0, -(-n // size), np.full(len(reps), n, np.int64)
    rows = lambda a, b: min(b * size, n) - a * size
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _binomial(_uniform(seed, lo, hi, reps), left, rows(lo, mid) / rows(lo, hi))
        lo, hi, left = (lo, mid, first) if chunk < mid else (mid, hi, left - first)
    return left


def _uniform(seed: int, lo: int, hi: int, reps: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each resample at a node of the tree, from two counter hashes."""
    node = np.array([seed & 0xFFFFFFFF], np.uint64)
    for x in (lo + 1, hi, 0x9E3779B9):  # no chunk has the last one's number
        node = mix32(mix32(node) ^ np.uint64(x & 0xFFFFFFFF))
    high = mix32(node ^ reps.astype(np.uint64))
    low = mix32(high ^ np.uint64(0x85EBCA6B))
    return (high.astype(float) * 2.0**21 + (low >> np.uint64(11)).astype(float)) / 2.0**53


def _binomial(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Binomial numbers by inversion of uniform ones: exact sums of the distribution around its mean, wide enough for any u."""
    out = np.empty(len(u), np.int64)
    for i, (x, m) in enumerate(zip(u.tolist(), n.tolist())):
        if m == 0 or p >= 1:
            out[i] = m if p >= 1 else 0
            continue
        centre, reach = int(m * p), int(12 * np.sqrt(m * p * (1 - p)) + 40)
        k = np.arange(max(0, centre - reach), min(m, centre + reach) + 1)
        steps = np.log((m - k[:-1]) / (k[:-1] + 1) * (p / (1 - p)))
        log_mass = np.concatenate([[0.0], np.cumsum(steps)])
        mass = np.exp(log_mass - log_mass.max())
        total = np.cumsum(mass)
        out[i] = k[min(int(np.searchsorted(total, x * total[-1], side="right")), len(k) - 1)]
    return out


def times(seed: int, reps: np.ndarray, chunk: int, n: int, rows: int, size: int = CHUNK) -> np.ndarray:
    """[resamples, rows]: how often each row of a chunk is drawn."""
    draws = in_chunk(seed, reps, chunk, n, size)
    out = np.empty((len(reps), rows), np.int32)
    start = mix32(np.array([seed & 0xFFFFFFFF], np.uint64))
    for i, (rep, m) in enumerate(zip(reps.tolist(), draws.tolist())):
        key = mix32(mix32(start ^ np.uint64(rep)) ^ np.uint64(chunk & 0xFFFFFFFF))
        h = mix32(key ^ (np.arange(m, dtype=np.uint64) & MASK))
        out[i] = np.bincount((h * np.uint64(rows) >> np.uint64(32)).astype(np.int64), minlength=rows)
    return out


def times_sql(table: str, resamples: int, seed: int = 0) -> str:
    """CTE `drawn` (rep, ix) of a table that fits one chunk: ix is the 0-based place of every drawn row in the order."""
    k = ", ".join(mix32_sql(a, b) for a, b in (("s", "a"), ("xor(a, rp)", "b"), ("b", "c"), ("xor(c, jj)", "h")))
    return (
        f"drawn AS (SELECT rp::BIGINT AS rep, ((h * nn) >> 32)::BIGINT AS ix FROM (SELECT {seed}::UBIGINT AS s, r.i::UBIGINT AS rp, d.i::UBIGINT AS jj, m.n::UBIGINT AS nn, {k} "
        f"FROM range({resamples}) r(i), range((SELECT count(*) FROM {table})) d(i), (SELECT count(*) AS n FROM {table}) m))"
    )


def chunked(df: DataFrame, resamples: int, order: list, size: int = CHUNK) -> tuple[DataFrame, int]:
    """(df with place, chunk and unit, n): a unit is a chunk and a block of resamples."""
    placed = running_total(df, order, out="place")
    n = df.count()
    if n < 3:
        raise ValueError("a bootstrap needs three rows at least")
    units = F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // REPS) - 1)))
    return placed.withColumn("chunk", F.floor(F.col("place") / size)).withColumn("unit", units), n


def _reps(pdf: pd.DataFrame, resamples: int) -> np.ndarray:
    at = int(pdf["unit"].iat[0])
    return np.arange(at * REPS, min(resamples, (at + 1) * REPS))


def resampled(df: DataFrame, resamples: int, seed: int = 0, order: str = "seq", size: int = CHUNK) -> DataFrame:
    """df's rows with rep and times: how often each is drawn in each resample; rows that are not drawn are left out.

    For metrics that need every drawn row; sums and areas under curves have states below.
    """
    units, n = chunked(df, resamples, [order], size)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __reps array<long>, __times array<long>"

    columns = df.columns

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        reps = _reps(pdf, resamples)
        t = times(seed, reps, int(pdf["chunk"].iat[0]), n, len(pdf), size)
        hit = [np.flatnonzero(t[:, i]) for i in range(len(pdf))]
        return pdf[columns].assign(__reps=[reps[h] for h in hit], __times=[t[h, i].astype(np.int64) for i, h in enumerate(hit)])

    out = units.groupBy("chunk", "unit").applyInPandas(draw, schema)
    return out.select(*columns, F.explode(F.arrays_zip(F.col("__reps").alias("rep"), F.col("__times").alias("times"))).alias("d")).select(*columns, "d.rep", "d.times")


def sums(df: DataFrame, columns: list[str], resamples: int, seed: int = 0, order: str = "seq", size: int = CHUNK) -> DataFrame:
    """(rep, n, columns..): the sums of columns over the rows drawn in each resample, and rep -1 over all rows once."""
    units, n = chunked(df.select(*dict.fromkeys([order, *columns])), resamples, [order], size)

    def state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        reps, x = _reps(pdf, resamples), np.hstack([np.ones((len(pdf), 1)), pdf[columns].to_numpy(float)])
        t = times(seed, reps, int(pdf["chunk"].iat[0]), n, len(pdf), size)
        found, who = [t @ x], [reps]
        if reps[0] == 0:
            found.append(x.sum(0)[None, :])
            who.append(np.array([-1]))
        return pd.DataFrame(np.vstack(found), columns=["n", *columns]).assign(rep=np.concatenate(who))

    part = units.groupBy("chunk", "unit").applyInPandas(state, "rep long, n double, " + ", ".join(f"`{c}` double" for c in columns))
    return part.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ["n", *columns]])


def areas(df: DataFrame, resamples: int, seed: int = 0, size: int = CHUNK) -> DataFrame:
    """(rep, auc) of (seq, label, score): the area under the ROC curve of each resample, lower scores first, NULL with one class.

    Rows are drawn in the order of scores, so a chunk is a stretch of the ranking.
    """
    units, n = chunked(df.select("seq", "label", F.col("score").cast("double").alias("score")), resamples, ["score", "seq"], size)

    def state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        reps, chunk = _reps(pdf, resamples), int(pdf["chunk"].iat[0])
        t = times(seed, reps, chunk, n, len(pdf), size)
        label, score = pdf["label"].to_numpy(), pdf["score"].to_numpy(float)
        starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        a = np.add.reduceat(t * (label == 1), starts, axis=1).astype(float)  # actives and decoys of every score
        d = np.add.reduceat(t * (label == 0), starts, axis=1).astype(float)
        before = np.cumsum(a, axis=1) - a
        edge = sorted({0, len(starts) - 1})  # these scores may go on in another chunk
        inner = np.ones(len(starts), bool)
        inner[edge] = False
        rows = [pd.DataFrame({"rep": reps, "chunk": chunk, "inner": True, "score": 0.0, "a": a[:, inner].sum(1), "d": d[:, inner].sum(1), "w": (d * (before + a / 2))[:, inner].sum(1), "before": 0.0})]
        rows += [pd.DataFrame({"rep": reps, "chunk": chunk, "inner": False, "score": score[starts[k]], "a": a[:, k], "d": d[:, k], "w": 0.0, "before": before[:, k]}) for k in edge]
        return pd.concat(rows)

    got = units.groupBy("chunk", "unit").applyInPandas(state, "rep long, chunk long, inner boolean, score double, a double, d double, w double, before double")
    ahead = got.groupBy("rep", "chunk").agg(F.sum("a").alias("a")).withColumn("ahead", F.coalesce(F.sum("a").over(Window.partitionBy("rep").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    all_ = got.join(ahead.select("rep", "chunk", "ahead"), ["rep", "chunk"])
    inner = all_.where("inner").select("rep", "a", "d", (F.col("w") + F.col("d") * F.col("ahead")).alias("w"))
    tied = all_.where("NOT inner").groupBy("rep", "score").agg(F.sum("a").alias("a"), F.sum("d").alias("d"), F.min(F.col("ahead") + F.col("before")).alias("b"))
    both = inner.unionByName(tied.select("rep", "a", "d", (F.col("d") * (F.col("b") + F.col("a") / 2)).alias("w")))
    total = both.groupBy("rep").agg(F.sum("a").alias("a"), F.sum("d").alias("d"), F.sum("w").alias("w"))
    return total.select("rep", F.when((F.col("a") > 0) & (F.col("d") > 0), F.col("w") / (F.col("a") * F.col("d"))).alias("auc"))


def bounds(values, resamples: int, confidence: float = 0.95) -> tuple[float | None, float | None, int]:
    """(low, high, defined) of the values of all resamples: undefined ones are skipped, and fewer than half defined give no bounds."""
    known = np.array([v for v in values if v is not None and np.isfinite(v)], float)
    if 2 * len(known) < resamples or not len(known):
        return None, None, len(known)
    low, high = np.percentile(known, [50 * (1 - confidence), 50 * (1 + confidence)])
    return float(low), float(high), len(known)

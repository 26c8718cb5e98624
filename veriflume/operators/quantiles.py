"""Exact percentiles of many columns and groups by distributed selection.

A rank is found by narrowing: mergeable sketches give a bracket around each rank wanted, one pass counts what lies below and inside it,
and the bracket is narrowed again over what is inside, until few enough values are left to fetch, or only one. Each pass cuts a
bracket by a factor of thousands, so two or three serve any size; no task holds more than a sketch. Percentiles between two ranks
are interpolated linearly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows in a bracket that are fetched; the sketches' accuracy, whose inverse is their greatest error as a share of the rows
FETCH, ACCURACY = 20_000, 10_000


def percentiles(df: DataFrame, columns: list[str], probabilities: list[float], by: str | None = None, fetch: int = FETCH, accuracy: int = ACCURACY) -> DataFrame:
    """(by, column, n, values): values[i] is the percentile at probabilities[i] of a column's known values, NULL of none.

    NULL and NaN are not counted. The driver holds a bracket for each group, column and probability: groups are few. Groups and columns
    without values give a row if the group has rows.
    """
    spark = df.sparkSession
    group = F.lit(None).cast("string") if by is None else F.col(by)
    kind = "string" if by is None else df.schema[by].dataType.simpleString()
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    long = df.select(group.alias("g"), F.explode(F.array(*[F.struct(F.lit(i).alias("c"), value(c).alias("v")) for i, c in enumerate(columns)])).alias("x")).select("g", "x.*")
    sizes = {(r["g"], r["c"]): r["n"] for r in long.groupBy("g", "c").agg(F.count("v").alias("n")).collect()}  # a row a group and column
    if not sizes and by is None:
        sizes = {(None, i): 0 for i in range(len(columns))}
    # one bracket a rank: [low, high], and how many values lie below it and in it
    brackets, found = {}, {}
    for (g, c), n in sizes.items():
        for p in probabilities:
            for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))} if n else ():
                brackets[g, c, rank] = (-math.inf, math.inf, 0, n)
    values = long.where("v IS NOT NULL")
    while brackets:
        small = {k: b for k, b in brackets.items() if b[3] <= fetch or b[0] == b[1]}
        if small:
            found |= _fetched(values, small, kind)
            brackets = {k: b for k, b in brackets.items() if k not in small}
        if brackets:
            brackets = _narrowed(values, brackets, kind, accuracy)
    rows = []
    for (g, c), n in sizes.items():
        out = []
        for p in probabilities:
            at = p * (n - 1)
            a, b = (found[g, c, math.floor(at)], found[g, c, math.ceil(at)]) if n else (None, None)
            out.append(None if not n else a if a == b else a + (b - a) * (at - math.floor(at)))
        rows.append((g, columns[c], n, out))
    out = spark.createDataFrame(rows, f"`{by or '__g'}` {kind}, column string, n long, values array<double>")
    return out if by else out.drop("__g")


def _table(values: DataFrame, brackets: dict, kind: str, extra: str = "", more=lambda k: ()) -> DataFrame:
    rows = [(*k, b[0], b[1], *more(k)) for k, b in brackets.items()]
    return F.broadcast(values.sparkSession.createDataFrame(rows, f"g {kind}, c int, rank long, low double, high double{extra}"))  # a row a bracket


def _fetched(values: DataFrame, brackets: dict, kind: str) -> dict:
    """The values at ranks whose brackets hold few rows, or one value."""
    out = {k: b[0] for k, b in brackets.items() if b[0] == b[1]}
    open_ = {k: b for k, b in brackets.items() if k not in out}
    if not open_:
        return out
    spans = {}  # ranks of a group and column often share a bracket: it is fetched once
    for (g, c, rank), b in open_.items():
        spans.setdefault((g, c, b[0], b[1]), (g, c, rank))
    table = _table(values, {k: open_[k] for k in spans.values()}, kind)
    met = values.alias("v").join(table.alias("b"), F.col("v.g").eqNullSafe(F.col("b.g")) & (F.col("v.c") == F.col("b.c")) & F.col("v").between(F.col("low"), F.col("high")))
    got = {}
    for r in met.groupBy("b.g", "b.c", "rank", F.col("v").alias("value")).agg(F.count("*").alias("n")).collect():
        got.setdefault((r["g"], r["c"], r["rank"]), []).append((r["value"], r["n"]))
    for k, b in open_.items():
        before = b[2]
        for v, n in sorted(got[spans[k[0], k[1], b[0], b[1]]]):
            before += n
            if k[2] < before:
                out[k] = v
                break
    return out


def _narrowed(values: DataFrame, brackets: dict, kind: str, accuracy: int) -> dict:
    """The brackets cut down to about 4 / accuracy of the rows in them; one that a sketch misses stays as it is but for a wider try."""
    near = lambda df: df.alias("v").join(table.alias("b"), F.col("v.g").eqNullSafe(F.col("b.g")) & (F.col("v.c") == F.col("b.c")))
    share = {k: (k[2] - b[2]) / max(1, b[3] - 1) for k, b in brackets.items()}
    table = _table(values, brackets, kind)
    steps = sorted({min(1.0, max(0.0, s + d * 2 / accuracy)) for s in share.values() for d in (-1, 1)})
    inside = near(values).where(F.col("v").between(F.col("low"), F.col("high")))
    sketched = inside.groupBy("b.g", "b.c", "rank").agg(F.percentile_approx("v", F.array(*[F.lit(s) for s in steps]), F.lit(accuracy)).alias("q")).collect()
    tries = {}
    for r in sketched:
        k = (r["g"], r["c"], r["rank"])
        low, high = (r["q"][steps.index(min(1.0, max(0.0, share[k] + d * 2 / accuracy)))] for d in (-1, 1))
        tries[k] = (low if share[k] > 2 / accuracy else brackets[k][0], high if share[k] < 1 - 2 / accuracy else brackets[k][1])
    table = _table(values, {k: (*t, 0, 0) for k, t in tries.items()}, kind)
    counts = near(values).groupBy("b.g", "b.c", "rank").agg(F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v").between(F.col("low"), F.col("high"))).alias("n")).collect()
    out = {}
    for r in counts:
        k = (r["g"], r["c"], r["rank"])
        hit = r["below"] <= k[2] < r["below"] + r["n"]
        if hit and r["n"] < brackets[k][3]:
            out[k] = (*tries[k], r["below"], r["n"])
        else:  # the sketch erred, or the values are too alike: halve the bracket by value
            low, high, below, n = brackets[k]
            low, high = (max(low, -1.7e308), min(high, 1.7e308))
            out[k] = _halved(values, k, (low, high, below, n), kind)
    return out


def _halved(values: DataFrame, k: tuple, bracket: tuple, kind: str) -> tuple:
    low, high, below, n = bracket
    mine = values.where(F.col("g").eqNullSafe(F.lit(k[0]).cast(kind)) & (F.col("c") == k[1]) & F.col("v").between(low, high))
    s = mine.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    middle = s["a"] / 2 + s["b"] / 2
    if s["a"] == s["b"]:
        return (s["a"], s["b"], below, n)
    t = mine.agg(F.count_if(F.col("v") <= middle).alias("n"), F.max(F.when(F.col("v") <= middle, F.col("v"))).alias("a"), F.min(F.when(F.col("v") > middle, F.col("v"))).alias("b")).first()
    return (s["a"], t["a"], below, t["n"]) if k[2] < below + t["n"] else (t["b"], s["b"], below + t["n"], n - t["n"])

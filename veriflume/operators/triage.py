"""Triage against a reference distribution, with a third verdict: a threshold that separates nothing withholds its cut."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .quantiles import percentiles
from .ranking import running_total

METHOD_ERROR = 2.5
#: least number of ranges that signature() streams
RANGES = 32


def _flagged(df: DataFrame) -> DataFrame:
    """kept, given passing and distinguishable flags: all assessed rows where nothing is distinguishable."""
    some = df.agg(F.coalesce(F.count_if("distinguishable"), F.lit(0)).alias("n_distinguishable"))
    out = df.crossJoin(F.broadcast(some))  # one row
    return out.withColumn("withheld", F.col("n_distinguishable") == 0).withColumn("kept", F.when(F.col("n_distinguishable") == 0, F.col("assessed")).otherwise(F.col("passing")))


def _percentile(df: DataFrame, column: str, p: float) -> float | None:
    return percentiles(df, [column], [p]).first()["values"][0]


def by_score(candidates: DataFrame, reference: DataFrame, percentile: float = 0.5, error: float = METHOD_ERROR) -> DataFrame:
    """candidates (best_score) with threshold, assessed, passing, distinguishable, withheld, kept; nothing is ranked."""
    df = candidates.withColumn("threshold", F.lit(_percentile(reference, "best_score", percentile)).cast("double"))
    s = F.col("best_score")
    df = df.withColumn("assessed", s.isNotNull()).withColumn("passing", F.coalesce(s <= F.col("threshold"), F.lit(False)))
    return _flagged(df.withColumn("distinguishable", F.col("passing") & (F.abs(s - F.col("threshold")) > error)))


def by_efficiency(candidates: DataFrame, reference: DataFrame, error: float = METHOD_ERROR) -> DataFrame:
    """The same on ligand efficiency against the reference median; a margin counts times the candidate's heavy atoms."""
    df = candidates.withColumn("threshold", F.lit(_percentile(reference, "ligand_efficiency", 0.5)).cast("double"))
    e = F.col("ligand_efficiency")
    df = df.withColumn("assessed", e.isNotNull()).withColumn("passing", F.coalesce(e <= F.col("threshold"), F.lit(False)))
    far = F.coalesce(F.abs(e - F.col("threshold")) * F.col("heavy_atoms") > error, F.lit(False))
    return _flagged(df.withColumn("distinguishable", F.col("passing") & far))


def survivors(triaged: DataFrame, profile_usable: bool) -> DataFrame:
    """triaged with set_aside: 'no strong feature', 'joined molecules', or NULL of what is left of the kept rows; NULL-kept rows are not there.

    A feature check without a profile that discriminates condemns nobody: only retains_strong_feature = false counts, and only where
    the profile is usable. A motif that an anchor needs once and a candidate has twice marks two molecules joined.
    """
    rows = triaged.where("kept")
    lost = F.coalesce(~F.col("retains_strong_feature"), F.lit(False)) if profile_usable else F.lit(False)
    joined = F.coalesce(F.size("duplicated_motifs") > 0, F.lit(False))
    return rows.withColumn("set_aside", F.when(lost, "no strong feature").when(joined, "joined molecules"))


def presented(rows: DataFrame, withheld: bool) -> DataFrame:
    """Survivors for a report: the most efficient first, unless the triage was withheld, when any order would claim too much."""
    left = rows.where("set_aside IS NULL")
    return left if withheld else left.orderBy(F.coalesce("ligand_efficiency", F.lit(0.0)), "seq")


def triage_counts(triaged: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: n_candidates, n_passing (kept), n_no_strong_feature, n_joined, n_survivors, withheld, n_distinguishable, threshold."""
    a = triaged.agg(F.count("*").alias("n_candidates"), F.count_if("kept").alias("n_passing"), F.bool_or("withheld").alias("withheld"), F.max("n_distinguishable").alias("n_distinguishable"), F.max("threshold").alias("threshold"))
    b = rows.agg(F.count_if(F.col("set_aside") == "no strong feature").alias("n_no_strong_feature"), F.count_if(F.col("set_aside") == "joined molecules").alias("n_joined"), F.count_if(F.col("set_aside").isNull()).alias("n_survivors"))
    return a.crossJoin(b)  # 1 x 1 rows


def pool_check(shards: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(by, n_<column> .., poolable): how many settings shards have of each kind; they are poolable only if there is one of each. NULL is a setting."""
    n = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"n_{c}") for c in columns]
    out = shards.groupBy(*([by] if by else [])).agg(*n)
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(f"n_{c}") <= 1)
    return out.withColumn("poolable", same)


def pool_problems(shards: DataFrame, columns: list[str]) -> list[str]:
    """The settings that differ among shards; pooling is refused unless there is none."""
    got = pool_check(shards, columns).first()
    return [c for c in columns if got[f"n_{c}"] > 1]

def signature(df: DataFrame, value: str, order: str) -> DataFrame:
    """First 16 hex digits of the sha256 of the newline-joined values in order, of a table of any size.

    A sha256 is sequential: its state is carried through the ordered ranges, one after the other, on the driver, which holds the rows
    of a range at a time and nothing of what it has passed. NULL values are left out.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(order).alias("__o"), F.col(value).cast("string").alias("__v")).where("__v IS NOT NULL")
    ordered = cut(rows.repartitionByRange(max(n, RANGES), "__o", "__v").sortWithinPartitions("__o", "__v")).orderBy("__o", "__v")
    state, first = hashlib.sha256(), True
    for row in ordered.select("__v").toLocalIterator(prefetchPartitions=True):
        state.update(row["__v"].encode() if first else b"\n" + row["__v"].encode())
        first = False
    return df.sparkSession.createDataFrame([(state.hexdigest()[:16],)], "signature string")


def five_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, low, q1, median, q3, high) of each arm's known values, by selection; arms are few."""
    q = percentiles(df, [value], [0.0, 0.25, 0.5, 0.75, 1.0], by)
    return q.select(by, "n", *[F.col("values")[i].alias(name) for i, name in enumerate(("low", "q1", "median", "q3", "high"))])


def median_shift(df: DataFrame, value: str, by: str, to: str, since: str) -> DataFrame:
    """(to, since, shift): how much the median of one arm lies above that of another; NULL if either is empty."""
    m = {r[by]: r["values"][0] for r in percentiles(df.where(F.col(by).isin(to, since)), [value], [0.5], by).collect()}
    a, b = m.get(to), m.get(since)
    return df.sparkSession.createDataFrame([(to, since, None if a is None or b is None else a - b)], "to string, since string, shift double")


def pass_rates(df: DataFrame, value: str, by: str, thresholds: DataFrame) -> DataFrame:
    """(by, n, n_passing, rate) of values at their arm's threshold or below. thresholds: (by, threshold), a row an arm; unknown values are not counted."""
    known = df.where(F.col(value).isNotNull()).join(F.broadcast(thresholds), by)
    return known.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(value) <= F.col("threshold")).alias("n_passing")).withColumn("rate", F.col("n_passing") / F.col("n"))


def determinism(df: DataFrame, setting: str, score: str, tolerance: float = 1e-6) -> DataFrame:
    """spread overall, largest spread within a setting, and what varies."""
    per = df.groupBy(setting).agg(F.min(score).alias("a"), F.max(score).alias("b"))
    out = per.agg((F.max("b") - F.min("a")).alias("spread"), F.max(F.col("b") - F.col("a")).alias("within"))
    return out.withColumn("verdict", F.when(F.col("spread") <= tolerance, "deterministic").when(F.col("within") <= tolerance, "varies with the setting").otherwise("varies by itself"))

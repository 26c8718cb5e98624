"""Leakage-free splits: groups are indivisible, so no scaffold is on two sides.

Groups are taken in order, each to the side furthest below its quota. The driver never holds the groups. Ordered by size, groups of one
size are a run, and what happens to a run is arithmetic: one side catches up, then sides take turns. A run is a row, and its places in
the plan are a handful of turns. Ordered by a seed's hash, only the sizes are streamed past the driver in order, which notes how full the
sides are every BLOCK groups; then tasks assign each block from where it starts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import running_total

#: groups assigned by one task, where their order is not that of their sizes
BLOCK = 100_000


class SplitError(ValueError):
    pass


def stable_hash(c: Column) -> Column:
    """First 16 hex digits of sha256: as text it orders as the number does."""
    return F.substring(F.sha2(c, 256), 1, 16)


def _name(key: str, ix: str) -> Column:
    return F.when(F.col(key) == "", F.concat(F.lit("<acyclic:"), F.col(ix).cast("string"), F.lit(">"))).otherwise(F.col(key))


def group_sizes(df: DataFrame, key: str = "scaffold", ix: str = "ix") -> DataFrame:
    return df.groupBy(_name(key, ix).alias("grp")).agg(F.count("*").alias("size"))


@dataclass
class Filling:
    """How full the sides are, and who comes next: the side furthest below its quota, or the first that is not full."""

    quota: dict[str, float]
    balanced: bool = True
    filled: dict[str, int] = field(default_factory=dict)
    groups: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.live = [p for p, q in self.quota.items() if q > 0]
        self.filled, self.groups = ({p: d.get(p, 0) for p in self.quota} for d in (self.filled, self.groups))

    def rank(self, side: str) -> tuple:
        return (self.quota[side] - self.filled[side], -self.quota[side], side)

    def next(self) -> str:
        if self.balanced:
            return max(self.live, key=self.rank)
        return next((p for p in ("test", "validation") if self.quota[p] and self.filled[p] < self.quota[p]), "train")

    def put(self, side: str, size: int, times: int = 1) -> None:
        self.filled[side] += size * times
        self.groups[side] += times

    def run(self, size: int, count: int) -> Iterator[tuple[int, list[str]]]:
        """(how many, turns): what happens to a run of groups of one size: so many of them go to the sides of turns, over and over."""
        while count:
            if not self.balanced:
                side = self.next()
                turns = [side]
                cycles = count if side == "train" else min(count, max(1, -int(-(self.quota[side] - self.filled[side]) // size)))
            else:
                order = sorted(self.live, key=self.rank, reverse=True)
                lack = [self.quota[p] - self.filled[p] for p in order]
                m = next((i for i in range(1, len(order)) if lack[0] - lack[i] >= size), len(order))  # these take turns until they meet the next
                turns = order[:m]
                cycles = count // m if m == len(order) else min(count // m, int((lack[m - 1] - lack[m]) // size))
                if cycles < 1:
                    turns, cycles = order[:1], 1
            for side in turns:
                self.put(side, size, cycles)
            count -= cycles * len(turns)
            yield cycles * len(turns), turns


def _quotas(n: int, test: float, validation: float) -> dict[str, float]:
    return {"test": test * n, "validation": validation * n, "train": (1 - test - validation) * n}


def repaired(state: Filling, groups: Iterable[tuple]) -> dict:
    """Moves of groups into sides that came out empty: {group: side}. groups: (group, size, side) in order, of those that may move.

    The side with most groups gives up the one whose size is closest to the quota, the first of them.
    """
    moved: dict = {}
    for side in state.live:
        if state.filled[side] or state.quota[side] < 1:
            continue
        donor = max((p for p in state.live if p != side), key=lambda p: state.groups[p], default=None)
        if donor is None or state.groups[donor] < 2:
            raise SplitError(f"too few groups to fill '{side}'")
        group, size = min(((g, s) for g, s, p in groups if moved.get(g, p) == donor), key=lambda x: abs(x[1] - state.quota[side]))
        moved[group] = side
        state.filled[donor], state.groups[donor] = state.filled[donor] - size, state.groups[donor] - 1
        state.filled[side], state.groups[side] = size, 1
    if not state.filled["test"] or not state.filled["train"]:
        raise SplitError("a side came out empty")
    return moved


def assign(sizes: list[int], n: int, test: float, validation: float, balanced: bool = True) -> list[str]:
    """The partition of every group of a list, taken in order; then empty sides are repaired."""
    state, out = Filling(_quotas(n, test, validation), balanced), []
    for size in sizes:
        out.append(state.next())
        state.put(out[-1], size)
    for group, side in repaired(state, [(i, s, p) for i, (s, p) in enumerate(zip(sizes, out))]).items():
        out[group] = side
    return out


def _by_size(sizes: DataFrame, test: float, validation: float, balanced: bool) -> DataFrame:
    """(grp, partition) of (grp, size), the largest first, then by name: a row a distinct size on the driver."""
    runs = [(r["size"], r["m"]) for r in sizes.groupBy("size").agg(F.count("*").alias("m")).orderBy(F.desc("size")).collect()]
    if sum(m for _, m in runs) < 2:
        raise SplitError("a scaffold-disjoint split needs two groups")
    state = Filling(_quotas(sum(s * m for s, m in runs), test, validation), balanced)
    plan, some, at = [], {}, 0  # stretches of places with their turns; of every size and side two places that may move
    for size, count in runs:
        for many, turns in state.run(size, count):
            plan.append((at, turns))
            for i, side in enumerate(turns):
                places = some.setdefault((size, side), [])
                places += range(at + i, at + many, len(turns))[: 2 - len(places)]
            at += many
    moved = repaired(state, sorted((place, size, side) for (size, side), places in some.items() for place in places))
    placed = running_total(sizes, [F.desc("size"), "grp"], out="place")
    shared = sizes.sparkSession.sparkContext.broadcast(([p[0] for p in plan], [p[1] for p in plan], moved))  # a few rows a distinct size

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begins, turns, exceptions = shared.value
        for pdf in batches:
            out = []
            for place in pdf["place"].tolist():
                k = bisect_right(begins, place) - 1
                out.append(exceptions.get(place) or turns[k][(place - begins[k]) % len(turns[k])])
            yield pd.DataFrame({"grp": pdf["grp"], "partition": out})

    return placed.select("grp", "place").mapInPandas(sides, "grp string, partition string")


def _by_hash(sizes: DataFrame, seeds: list[int], test: float, validation: float, balanced: bool) -> DataFrame:
    """(seed, grp, partition) of (grp, size) under several seeds, groups in the order of a seed's hash of their names.

    One global order holds all seeds. Sizes are streamed past the driver, which keeps the sides' state at every BLOCK places and, for
    repairs, of every side the best group for each quota.
    """
    n, count = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if count < 2:
        raise SplitError("a scaffold-disjoint split needs two groups")
    spark = sizes.sparkSession
    each = sizes.withColumn("seed", F.explode(F.lit(seeds).cast("array<long>")))
    each = each.withColumn("h", stable_hash(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("grp"))))
    placed = cut(running_total(each, ["seed", "h", "grp"], out="at"))
    quota = _quotas(n, test, validation)
    starts, moves = [], {}
    seed = state = best = None

    def finish() -> None:
        moves.update(repaired(state, sorted({(at, size, side) for (side, _), two in best.items() for _, at, size in two})))

    for at, row in enumerate(placed.orderBy("at").select("seed", "size").toLocalIterator(prefetchPartitions=True)):
        if row["seed"] != seed:
            if state:
                finish()
            seed, state, best = row["seed"], Filling(quota, balanced), {}
        if at % BLOCK == 0 or (at and at % count == 0):
            starts.append((at, dict(state.filled), dict(state.groups)))
        side, size = state.next(), row["size"]
        state.put(side, size)
        for k, target in enumerate(state.live):
            two = best.setdefault((side, k), [])  # the two closest, which is what two repairs may need
            if len(two) < 2 or abs(size - quota[target]) < two[-1][0]:
                two[:] = sorted([*two, (abs(size - quota[target]), at, size)])[:2]
    finish()
    shared = spark.sparkContext.broadcast((starts, moves))
    blocked = placed.withColumn("block", F.floor(F.col("at") / BLOCK) + F.floor(F.col("at") / count))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        begun = {s[0]: s for s in shared.value[0]}
        out, now = [], None
        for at, size in zip(pdf["at"].tolist(), pdf["size"].tolist()):
            if at in begun:
                now = Filling(quota, balanced, *begun[at][1:])
            side = now.next()
            now.put(side, size)
            out.append(shared.value[1].get(at, side))
        return pd.DataFrame({"seed": pdf["seed"], "grp": pdf["grp"], "partition": out})

    return blocked.groupBy("block").applyInPandas(fill, "seed long, grp string, partition string")


def scaffold_split(df: DataFrame, test: float = 0.2, validation: float = 0.0, seed: int | None = None, balanced: bool = True, key: str = "scaffold", ix: str = "ix") -> DataFrame:
    """df with partition ('train', 'validation', 'test'); deterministic, whatever the order of rows. Rows with a NULL key are left out."""
    _check(test, validation)
    sizes = cut(group_sizes(df.where(F.col(key).isNotNull()), key, ix))
    plan = _by_size(sizes, test, validation, balanced) if seed is None else _by_hash(sizes, [seed], test, validation, balanced).drop("seed")
    return df.withColumn("grp", _name(key, ix)).join(plan, "grp").drop("grp")


def _check(test: float, validation: float) -> None:
    if not 0 < test < 1 or not 0 <= validation < 1 or test + validation >= 1:
        raise SplitError("fractions must leave data for every side")


def repeated(df: DataFrame, repeats: int = 5, test: float = 0.2, base_seed: int = 0, key: str = "scaffold", ix: str = "ix") -> DataFrame:
    """df under several seeded splits, with repeat, all of them from one order: one split has no error bar."""
    _check(test, 0.0)
    sizes = cut(group_sizes(df.where(F.col(key).isNotNull()), key, ix))
    plan = _by_hash(sizes, [base_seed + k for k in range(repeats)], test, 0.0, True)
    plan = plan.select("grp", "partition", (F.col("seed") - base_seed).cast("int").alias("repeat"))
    return df.withColumn("grp", _name(key, ix)).join(plan, "grp").drop("grp")


def by_scaffold(df: DataFrame, key: str = "scaffold") -> DataFrame:
    """(scaffold, n): acyclic rows, whose scaffold is '', are a group like any other; so are rows without one, NULL."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def random_split(df: DataFrame, test: float = 0.2, seed: int = 0, ix: str = "ix") -> DataFrame:
    """The n_test rows with the lowest counter hash are the test side (not a Mersenne-twister permutation)."""
    from .ranking import counter_hash

    n_test = max(1, round(test * df.count()))
    placed = running_total(df, [counter_hash(F.lit(str(seed)), F.col(ix).cast("string")), ix])
    return placed.withColumn("partition", F.when(F.col("before") < n_test, "test").otherwise("train")).drop("before")


def leaks(split: DataFrame, key: str = "scaffold") -> DataFrame:
    """Scaffolds on several sides; blank ones are exempt."""
    return split.where(F.col(key) != "").groupBy(key).agg(F.count_distinct("partition").alias("sides")).where("sides > 1")


def coverage(split: DataFrame, ix: str = "ix") -> DataFrame:
    return split.agg(F.count("*").alias("n"), F.count_distinct(ix).alias("n_distinct"), F.count("partition").alias("n_placed"))


def diversity(df: DataFrame, key: str = "scaffold") -> DataFrame:
    """n, n_unparseable, n_acyclic, n_scaffolds, largest share, singletons, two warnings."""
    per = df.groupBy(key).agg(F.count("*").alias("c"))
    real = (F.col(key) != "") & F.col(key).isNotNull()
    return per.agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("c"))), F.lit(0)).alias("n_unparseable"), F.coalesce(F.sum(F.when(F.col(key) == "", F.col("c"))), F.lit(0)).alias("n_acyclic"),
        F.count_if(real).alias("n_scaffolds"), F.try_divide(F.max(F.when(real, F.col("c"))), F.sum("c")).alias("largest_share"), F.count_if(real & (F.col("c") == 1)).alias("n_singletons"),
        (F.count_if(real) < 10).alias("few_scaffolds"), F.coalesce(F.try_divide(F.max(F.when(real, F.col("c"))), F.sum("c")) > 0.5, F.lit(False)).alias("dominated"),
    )

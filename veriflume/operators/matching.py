"""Matched controls: tolerance joins, greedy selection, group gaps and their balancing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .similarity import every_pair

# Per-pair and group tolerances of the matched properties.
TOLERANCES = {"molecular_weight": 25.0, "logp": 1.0, "hbd": 1.0, "hba": 2.0, "rotatable_bonds": 2.0, "formal_charge": 0.0}
GROUP_TOLERANCES = {**TOLERANCES, "formal_charge": 0.15}
MAX_SIMILARITY, PER_ACTIVE = 0.25, 10
#: pairs that one task settles at once; rows fetched at each end of a property; ids of copies that travel together; rows of a group that one task matches
CELL, FRONTIER, CHUNK, ROWS = 500_000, 500, 1_000, 4_000_000


def _copies(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kinds (id, __n, properties), members (__of, id)): rows of equal properties are one kind, named by its lowest id."""
    kinds = rows.groupBy(*names).agg(F.min("id").alias("id"), F.count("*").alias("__n"))
    k = kinds.select(F.col("id").alias("__of"), *[F.col(p).alias(f"__p_{p}") for p in names])
    same = reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(f"__p_{p}")) for p in names])
    return kinds, rows.join(k, same).select("__of", "id")


def tolerance_pairs(actives: DataFrame, candidates: DataFrame, tolerances: dict[str, float], bucket: str) -> DataFrame:
    """(active, candidate, distance) of pairs within every tolerance; a property that either side lacks is left out.

    Rows of equal properties have the same pairs: kinds of rows are compared, and what matches is written out for their members. All that is
    exchanged is kinds, members, and ids by the CHUNK.
    """
    names = list(tolerances)
    (a, mine), (c, theirs) = _copies(actives, names), _copies(candidates, names)
    place = F.floor((F.row_number().over(Window.partitionBy("__of").orderBy("id")) - 1) / CHUNK)
    packed = theirs.withColumn("__c", place).groupBy(F.col("__of").alias("candidate"), "__c").agg(F.collect_list("id").alias("ids"))  # CHUNK at most
    found = kind_pairs(a, c, tolerances, bucket).join(packed, "candidate").select(F.col("active").alias("__of"), "ids", "distance")
    return found.join(mine, "__of").select(F.col("id").alias("active"), F.explode("ids").alias("candidate"), "distance")


def closest_controls(actives: DataFrame, candidates: DataFrame, tolerances: dict[str, float], bucket: str) -> DataFrame:
    """(active, n, closest): how many candidates each active has within every tolerance, and the least distance; none: no row.

    What groupBy gives of tolerance_pairs, without writing pairs out.
    """
    names = list(tolerances)
    (a, mine), (c, _) = _copies(actives, names), _copies(candidates, names)
    per = kind_pairs(a, c, tolerances, bucket).join(c.select(F.col("id").alias("candidate"), "__n"), "candidate").groupBy(F.col("active").alias("__of")).agg(F.sum("__n").alias("n"), F.min("distance").alias("closest"))
    return mine.join(per, "__of").select(F.col("id").alias("active"), "n", "closest")


def kind_pairs(actives: DataFrame, candidates: DataFrame, tolerances: dict[str, float], bucket: str) -> DataFrame:
    """(active, candidate, distance) of rows (id, properties) as they stand, copies one by one.

    An equi-join on buckets of one wide property, as wide as its tolerance: an active visits three. Zero tolerances are
    equi-join keys too. Distance is the sum of differences over tolerances. Rows that lack one of the joined properties, which
    should be few, meet all rows of the other side, block by block.
    """
    wide, names = tolerances[bucket], list(tolerances)
    exact = [p for p, t in tolerances.items() if t == 0]
    a = actives.select(F.col("id").alias("active"), *[F.col(p).cast("double").alias(f"a_{p}") for p in names])
    c = candidates.select(F.col("id").alias("candidate"), *[F.col(p).cast("double").alias(f"c_{p}") for p in names])
    whole = lambda s: reduce(lambda x, y: x & y, [F.col(f"{s}_{p}").isNotNull() for p in [bucket, *exact]])
    gap = {p: F.abs(F.col(f"a_{p}") - F.col(f"c_{p}")) for p in names}
    fits, total = F.lit(True), F.lit(0.0)
    for p, t in tolerances.items():
        fits, total = fits & F.coalesce(gap[p] <= t, F.lit(True)), total + F.coalesce(gap[p] / (t if t > 0 else 1.0), F.lit(0.0))
    found = lambda pairs: pairs.where(fits).select("active", "candidate", total.alias("distance"))
    base = F.floor(F.col(f"a_{bucket}") / wide)
    left = a.where(whole("a")).withColumn("__k", F.explode(F.array(base - 1, base, base + 1)))
    right = c.where(whole("c")).withColumn("__k", F.floor(F.col(f"c_{bucket}") / wide))
    on = left["__k"] == right["__k"]
    for p in exact:
        on = on & (F.col(f"a_{p}") == F.col(f"c_{p}"))
    out = found(left.join(right, on))
    for odd_a, odd_c in ((a.where(~whole("a")), c), (a.where(whole("a")), c.where(~whole("c")))):
        if not (odd_a if odd_c is c else odd_c).isEmpty():
            out = out.unionByName(found(every_pair(odd_a, odd_c)))
    return out


def drop_similar(pairs: DataFrame, max_similarity: DataFrame, limit: float = MAX_SIMILARITY) -> DataFrame:
    """Pairs without candidates that resemble any active more than limit. max_similarity: (candidate, similarity)."""
    return pairs.join(max_similarity.where(F.col("similarity") > limit).select("candidate"), "candidate", "left_anti")


def greedy_match(pairs: DataFrame, per_active: int = PER_ACTIVE, cell: int = CELL) -> DataFrame:
    """(active, candidate, distance): actives in order take their closest free candidates, ties to the lowest id.

    Actives are dealt to cells of consecutive ids with about `cell` pairs. A cell's task goes through its actives in order; one is settled
    once all it takes is free beyond doubt: no smaller active of another cell still wants it, and no unsettled one before it in the
    cell. What is settled leaves, with the candidates that it takes, and the rest is dealt anew. The first cell is always settled
    whole, and what fits into one cell ends in it, so a chain of any length up to `cell` pairs takes one round. A task streams its
    pairs in order and holds the candidates of its cell that are taken or in doubt.
    """
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("active", "candidate")}
    rows, settled = cut(pairs.select("active", "candidate", F.col("distance").cast("double").alias("distance"))), None

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, doubt, now, mine, first = set(), set(), None, [], None

        def close() -> list[tuple]:
            got, sure = [], True
            for candidate, distance, wanted in mine:
                if len(got) == per_active:
                    break
                if candidate in taken:
                    continue
                sure = sure and candidate not in doubt and not wanted < first
                got.append((now, candidate, distance))
            if sure:
                taken.update(c for _, c, _ in got)
                return got or [(now, None, None)]
            doubt.update(c for c, _, _ in mine)  # it may take any of them
            return []

        for pdf in batches:
            out = []
            for active, candidate, distance, wanted in zip(pdf["active"].tolist(), pdf["candidate"].tolist(), pdf["distance"].tolist(), pdf["wanted"].tolist()):
                if active != now:
                    if now is not None:
                        out += close()
                    first = active if first is None else first
                    now, mine = active, []
                mine.append((candidate, distance, wanted))
            yield frame(out)
        if now is not None:
            yield frame(close())

    frame = lambda out: pd.DataFrame(out, columns=["active", "candidate", "distance"], dtype=object)
    while n := rows.count():
        # `wanted`: the smallest active that may still take a candidate
        asked = rows.join(rows.groupBy("candidate").agg(F.min("active").alias("wanted")), "candidate")
        dealt = asked.select("active", "candidate", "distance", "wanted").repartitionByRange(max(1, -(-n // cell)), "active").sortWithinPartitions("active", "distance", "candidate")
        done = cut(dealt.mapInPandas(settle, f"active {kinds['active']}, candidate {kinds['candidate']}, distance double"))
        got = done.where("candidate IS NOT NULL")
        settled = got if settled is None else settled.unionByName(got)
        rows = cut(rows.join(done.select("active").distinct(), "active", "left_anti").join(got.select("candidate"), "candidate", "left_anti"))
    return rows if settled is None else settled


def match(actives: DataFrame, candidates: DataFrame, tolerances: dict[str, float], bucket: str, per_active: int = PER_ACTIVE, digits: int | None = None, rows: int = ROWS) -> DataFrame:
    """(active, candidate, distance): what greedy_match takes from tolerance_pairs, whose distances are rounded to `digits` if given.

    The choice is sequential, in the order of actives, but only among rows that agree in the properties of no tolerance: a task goes through
    one such group of up to `rows` rows. Candidates of equal properties are a queue; an active walks the queues by distance and takes
    from their heads, so pairs are never written. Larger groups, and rows that lack what groups them, go by pairs and cells.
    """
    names, exact = list(tolerances), [p for p, t in tolerances.items() if t == 0]
    cols = [F.col(p).cast("double").alias(p) for p in names]
    both = actives.select(F.lit(0).alias("side"), "id", *cols).unionByName(candidates.select(F.lit(1).alias("side"), "id", *cols))
    both = cut(both.join(actives.select(*[F.col(p).cast("double").alias(p) for p in exact]).distinct(), exact, "left_semi") if exact and not _lacks(actives, candidates, exact) else both)
    odd = reduce(lambda x, y: x | y, [F.coalesce(F.isnan(p), F.lit(False)) for p in names] + [F.col(p).isNull() for p in exact])
    s = both.groupBy(*exact).agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).agg(F.max("n").alias("n"), F.sum("odd").alias("odd")).first()
    if (s["n"] or 0) > rows or s["odd"]:
        pairs = tolerance_pairs(actives, candidates, tolerances, bucket)
        return greedy_match(pairs if digits is None else pairs.withColumn("distance", F.round("distance", digits)), per_active)
    kind = {f.name: f.dataType.simpleString() for f in both.schema}["id"]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _walked(pdf[pdf["side"] == 0], pdf[pdf["side"] == 1], tolerances, per_active, digits)
        return pd.DataFrame(out, columns=["active", "candidate", "distance"], dtype=object)

    return both.groupBy(*exact).applyInPandas(settle, f"active {kind}, candidate {kind}, distance double")


def _lacks(actives: DataFrame, candidates: DataFrame, exact: list[str]) -> bool:
    some = reduce(lambda x, y: x | y, [F.col(p).isNull() for p in exact])
    return not actives.where(some).isEmpty() or not candidates.where(some).isEmpty()


def _walked(actives: pd.DataFrame, candidates: pd.DataFrame, tolerances: dict[str, float], per_active: int, digits: int | None, held: int = 10_000_000) -> list[tuple]:
    """(active, candidate, distance) that one group's actives take in the order of their ids. held: entries of walks that are kept at once."""
    if not len(actives) or not len(candidates):
        return []
    names = list(tolerances)
    actives, candidates = actives.sort_values("id", kind="stable"), candidates.sort_values("id", kind="stable")
    code = candidates.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    ids = candidates["id"].to_numpy()[order].tolist()
    end = np.cumsum(np.bincount(code))
    head = end - np.bincount(code)  # of every queue
    kinds = candidates[names].to_numpy(float)[order[head]]
    mine, wanted = actives.groupby(names, dropna=False, sort=False).ngroup().to_numpy(), actives[names].to_numpy(float)
    walks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    size, out = 0, []
    for who, m, row in zip(actives["id"].tolist(), mine.tolist(), wanted):
        if m not in walks:
            fits, total = head < end, np.zeros(len(kinds))
            for j, t in enumerate(tolerances.values()):
                gap = np.abs(row[j] - kinds[:, j])
                none = np.isnan(gap)  # either side lacks it
                fits, total = fits & (none | (gap <= t)), total + np.where(none, 0.0, gap / (t if t > 0 else 1.0))
            at = np.flatnonzero(fits)
            d = total[at] if digits is None else np.round(total[at], digits)
            by = np.argsort(d, kind="stable")
            if size > held:
                walks, size = {}, 0
            walks[m] = (at[by], d[by])
            size += len(at)
        queues, d = walks[m]
        i, got, passed = 0, 0, 0
        while got < per_active and i < len(queues):
            if head[queues[i]] == end[queues[i]]:
                i, passed = i + 1, passed + 1
                continue
            j, run = i, []
            while j < len(queues) and d[j] == d[i]:
                if head[queues[j]] < end[queues[j]]:
                    run.append(queues[j])
                j += 1
            while run and got < per_active:
                q = min(run, key=lambda q: ids[head[q]])
                out.append((who, ids[head[q]], float(d[i])))
                head[q], got = head[q] + 1, got + 1
                if head[q] == end[q]:
                    run.remove(q)
            i = j
        if passed > 32:
            left = head[queues] < end[queues]
            walks[m] = (queues[left], d[left])
    return out


def shared_properties(a: DataFrame, b: DataFrame) -> list[str]:
    """Names that both tables have, sorted, without their ids and labels."""
    return sorted((set(a.columns) & set(b.columns)) - {"id", "label"})


def property_gap(df: DataFrame, properties: list[str], label: str = "label") -> DataFrame:
    """(property, gap, concerning): mean over label 1 less mean over label 0, and whether that alone could make a score separate them."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("double").alias("v"), F.lit(GROUP_TOLERANCES.get(p)).cast("double").alias("t")) for p in properties])).alias("x")).select(label, "x.*")
    per = long.groupBy("property").agg((F.avg(F.when(F.col(label) == 1, F.col("v"))) - F.avg(F.when(F.col(label) == 0, F.col("v")))).alias("gap"), F.max("t").alias("__t"))
    return per.select("property", "gap", F.coalesce(F.abs("gap") > F.col("__t"), F.lit(False)).alias("concerning"))

def balance(actives: DataFrame, decoys: DataFrame, tolerances: dict[str, float] = GROUP_TOLERANCES, min_keep: float = 0.6, frontier: int = FRONTIER, passes: list | None = None) -> DataFrame:
    """The decoys (id, properties) left after removing, one by one, whichever most reduces the worst gap over its tolerance.

    A pass fetches the rows that are extreme in some direction, `frontier` of each: both ends of every property, and, as the best removal
    often helps two properties a little, the sums of two in the direction of their gaps. The worst gap is no smaller than a mean of gaps,
    so what a direction holds beyond the fetched rows bounds how much any other row could help. While the best of the fetched rows beats
    that bound it is the best of all, and removals follow each other without another pass; where it is not beaten, a pass over all rows finds
    the next one. Gaps without a row follow from sums and counts. Stops at 1, at the floor, or when no removal helps; ties go to the
    lowest id. Removed ids, a frontier at a time, are written off. passes, if given, gets an entry for each pass.
    """
    names = [p for p, t in tolerances.items() if t > 0 and p in decoys.columns]
    if not names:
        return decoys
    mean = actives.agg(*[F.avg(p).alias(p) for p in names]).first()
    kept = decoys
    rows = lambda: kept.select("id", *[F.col(p).cast("double").alias(p) for p in names])
    s = rows().agg(F.count("*").alias("n"), *[F.sum(p).alias(p) for p in names], *[F.count(p).alias(f"k_{p}") for p in names]).first()
    n, total, whole = s["n"], {p: s[p] for p in names}, [p for p in names if s[f"k_{p}"] == s["n"]]
    floor = max(2, int(min_keep * n))
    known = [p for p in names if total[p] is not None and mean[p] is not None]
    off = lambda p, t, m: (mean[p] - t / m) / tolerances[p]
    worst = lambda: max((abs(off(p, total[p], n)) for p in known), default=0.0)
    seen: dict = {}
    gone: list = []
    ways: list = []

    def error(row) -> float:
        return max((abs(off(p, total[p] - row[p], n - 1)) for p in known if row[p] is not None), default=0.0)

    def beyond() -> float:
        """No row that was not fetched leaves a smaller worst gap than this."""
        return max((sum(c * (mean[p] - total[p] / (n - 1)) for p, c in way.items()) + end / (n - 1) for way, end in ways if set(way) <= set(whole)), default=0.0)

    while n > floor and worst() > 1:
        if not seen:
            if gone:
                kept, gone = cut(kept.where(~F.col("id").isin(gone))), []
            if passes is not None:
                passes.append("frontier")
            sign = {p: 1.0 if off(p, total[p], n) > 0 else -1.0 for p in known}
            one = [{p: s / tolerances[p]} for p in known for s in (1.0, -1.0)]
            two = [{p: sign[p] / 2 / tolerances[p], q: sign[q] / 2 / tolerances[q]} for i, p in enumerate(known) for q in known[i + 1 :]]
            fetched, ways = _extremes(rows(), one + two, frontier)
            seen, all_in = {r["id"]: r for r in fetched}, n <= len({r["id"] for r in fetched})
        e, who = min((error(r), i) for i, r in seen.items())
        if not all_in and not e < beyond():
            if gone:
                kept, gone = cut(kept.where(~F.col("id").isin(gone))), []
            if passes is not None:
                passes.append("whole")
            without = F.greatest(*[F.abs(F.lit(mean[p]) - (F.lit(total[p]) - F.col(p)) / (n - 1)) / tolerances[p] for p in known], F.lit(0.0))
            row = rows().agg(F.min(F.struct(without.alias("e"), F.col("id").alias("id"), *names)).alias("b")).first()["b"]
            e, who = row["e"], row["id"]
            seen = {}  # what was fetched does not reach far enough any more
        else:
            row = seen.pop(who)
        if not e < worst():
            break
        gone.append(who)
        n, total = n - 1, {p: total[p] - (row[p] or 0.0) if p in known else total[p] for p in names}
    return kept.where(~F.col("id").isin(gone)) if gone else kept


def _extremes(rows: DataFrame, ways: list[dict[str, float]], many: int) -> tuple[list, list[tuple[dict[str, float], float]]]:
    """(rows, [(way, end)]): the `many` rows with the smallest sum of coefficient x property in each way, and the largest of these sums.

    Tasks send their own extremes on, so what meets is bounded by tasks, ways and many. Rows without one of a way's properties are not in it.
    """
    names = [c for c in rows.columns if c != "id"]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            keep = set()
            for way in ways:
                v = sum(c * held[p] for p, c in way.items()).dropna()
                keep.update(np.argsort(v.to_numpy(), kind="stable")[:many].tolist() if len(v) == len(held) else held.index.get_indexer(v.nsmallest(many).index).tolist())
            held = held.iloc[sorted(keep)].reset_index(drop=True)
        if held is not None:
            yield held

    near = rows.mapInPandas(local, rows.schema).repartition(1).mapInPandas(local, rows.schema).collect()
    at = lambda way: sorted(sum(c * r[p] for p, c in way.items()) for r in near if all(r[p] is not None for p in way))[:many]
    return near, [(way, v[-1]) for way in ways if (v := at(way))]


def match_quality(matched: DataFrame, actives: DataFrame, candidates: DataFrame, tolerances: dict[str, float], per_active: int, max_similarity: DataFrame | None = None, limit: float = MAX_SIMILARITY) -> DataFrame:
    """One row of how well matched (active, candidate) pairs match: n_wanted, n_found, mean_gaps (mean difference of each property),
    max_similarity of what was chosen, unmet (reason to number), adequate: half of what was asked for, and no mean beyond its tolerance.

    max_similarity: (candidate, similarity) to the most similar active.
    """
    names = [p for p in tolerances if p in actives.columns and p in candidates.columns]
    a = actives.select(F.col("id").alias("active"), *[F.col(p).cast("double").alias(f"a_{p}") for p in names])
    c = candidates.select(F.col("id").alias("candidate"), *[F.col(p).cast("double").alias(f"c_{p}") for p in names])
    pairs = matched.select("active", "candidate").join(a, "active").join(c, "candidate")
    pairs = pairs.withColumn("similarity", F.lit(None).cast("double")) if max_similarity is None else pairs.join(max_similarity.select("candidate", "similarity"), "candidate", "left")
    mean = {p: F.avg(F.abs(F.col(f"a_{p}") - F.col(f"c_{p}"))) for p in names}
    known = F.filter(F.array(*[F.struct(F.lit(p).alias("k"), m.alias("v")) for p, m in mean.items()]), lambda x: x["v"].isNotNull())
    within = F.lit(True)
    for p in names:
        within = within & F.coalesce(mean[p] <= tolerances[p], F.lit(True))
    got = pairs.agg(F.count("*").alias("n_found"), F.map_from_entries(known).alias("mean_gaps"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("max_similarity"), within.alias("__w"))
    per = actives.select(F.col("id").alias("active")).join(matched.groupBy("active").agg(F.count("*").alias("n")), "active", "left")
    short = per.agg(F.count("*").alias("__n"), F.count_if(F.coalesce("n", F.lit(0)) < per_active).alias("__few"))
    too = (candidates.limit(0) if max_similarity is None else max_similarity.where(F.col("similarity") > limit)).agg(F.count("*").alias("__too"))
    out = got.crossJoin(short).crossJoin(too)  # one row each
    reasons = F.map_filter(F.create_map(F.lit("actives left short"), F.col("__few"), F.lit(f"controls too alike, over {limit:g}"), F.col("__too")), lambda k, v: v > 0)
    asked = F.col("__n") * per_active
    return out.select(asked.alias("n_wanted"), "n_found", "mean_gaps", "max_similarity", reasons.alias("unmet"), ((F.col("n_found") >= 0.5 * asked) & F.col("__w")).alias("adequate"))

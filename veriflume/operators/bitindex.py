"""Exact Tanimoto joins of fingerprints by an inverted index over their rarest set bits.

Bits are ranked by how many fingerprints have them, the rarest first. Two fingerprints with a and b set bits and a similarity of t
share ceil(t (a + b) / (1 + t)) bits at least. So the first bit that they share is one of the b - ceil(t b) + 1 rarest of the larger
one and of the a - ceil(2 t a / (1 + t)) + 1 rarest of the smaller: only these are listed, and a pair is met only if enough bits
are left behind it on both sides. A pair counts where its first shared bit is, and nowhere else. Searches for the nearest raise t:
a row's rarest bits give a first answer, which bounds how much of it has to be looked up in the second round.

Lists of a bit are cut to blocks, and pairs of blocks are units of their own, so a bit that most rows have fills many tasks and
none holds more than two blocks. Where even the rarest bits stand in so many rows that the lists would meet more pairs than there
are, all rows share one list instead: dense fingerprints have no rare bits to search by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: rows of a block; bits of the first round of a search; rows of one strip of a unit's matrix
BLOCK, FIRST, STRIP = 2048, 2, 256
#: references up to this many are compared where the rows are, without an exchange
BROADCAST_ROWS = 20_000
EPS = 1e-9
#: fingerprints of so many words are counted for all pairs of a strip
FEW_WORDS = 2
#: stands for all rows in the counts of bits, and for the list that all share
ALL = -1


def packed(fp: DataFrame, column: str = "word") -> DataFrame:
    """(id, words): fingerprints as arrays of 64-bit words; a column of one word is an array of one. NULL ones have no row."""
    whole = F.col(column) if fp.schema[column].dataType.typeName() == "array" else F.array(F.col(column).cast("long"))
    return fp.where(F.col(column).isNotNull()).select("id", whole.alias("words"))


def distinct_words(fp: DataFrame) -> DataFrame:
    """(words, id): the smallest id of every fingerprint. Copies are settled by it and meet nobody."""
    return fp.groupBy("words").agg(F.min("id").alias("id"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).view(np.uint64)


def _bits(words: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1, a column a bit."""
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def _counts(df: DataFrame, emit) -> dict[int, int]:
    """How often each number occurs in what emit makes of (words, bound), and under ALL how many rows there are.

    At most a number a bit, so the driver may hold it.
    """
    have = df if "bound" in df.columns else df.withColumn("bound", F.lit(0.0))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(0, np.int64), 0
        for pdf in batches:
            if len(pdf):
                got = emit(_matrix(pdf["words"]), pdf["bound"].to_numpy())
                total, n = got if not n else total + got, n + len(pdf)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bit": np.append(at, ALL), "n": np.append(total[at], n)})

    return {r["bit"]: r["n"] for r in have.select("words", "bound").mapInPandas(part, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n")).collect()}


class Ranking:
    """The order of the bits, the rarest first, and fingerprints rewritten into it: bit r of the result is the bit of rank r."""

    def __init__(self, frequency: dict[int, int], width: int):
        self.width = width
        self.order = np.array(sorted(range(width), key=lambda b: (frequency.get(b, 0), b)))
        self.n = frequency.get(ALL, 0)
        self.frequency = {r: n for r, b in enumerate(self.order.tolist()) if (n := frequency.get(b))}

    def ranked(self, words: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(_bits(words)[:, self.order])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.int64)


def ranking(df: DataFrame) -> Ranking | None:
    """The ranking of a table's bits, with its counts by rank; None of an empty table."""
    first = df.select(F.size("words").alias("n")).first()
    return None if first is None else Ranking(_counts(df, lambda w, _: _bits(w).sum(0, dtype=np.int64)), 64 * first["n"])


def prefix_of(bits: np.ndarray, threshold: float | np.ndarray) -> np.ndarray:
    """Which of each row's ranked bits belong to its prefix."""
    size = bits.sum(1, dtype=np.int64)
    length = size - np.ceil(size * threshold - EPS).astype(np.int64) + 1
    return (bits > 0) & (np.cumsum(bits, axis=1, dtype=np.int64) <= np.minimum(length, size)[:, None])


def similarities(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tanimoto similarities of all rows of packed words; 0 for two empty ones."""
    shared = sum(np.bitwise_count(x[:, k, None] & y[None, :, k]).astype(np.int64) for k in range(x.shape[1]))
    a, b = (np.bitwise_count(z).sum(1).astype(np.int64) for z in (x, y))
    whole = a[:, None] + b[None, :] - shared
    return np.where(whole > 0, shared / np.maximum(whole, 1), 0.0)


def behind(words: np.ndarray, rank: int) -> np.ndarray:
    """How many bits each row has from a rank on; ALL: all of them."""
    mask = np.zeros(words.shape[1], np.uint64)
    at = max(rank, 0)
    mask[at // 64 + 1 :] = ~np.uint64(0)
    mask[at // 64] = ~np.uint64(0) << np.uint64(at % 64)
    return np.bitwise_count(words & mask).sum(1).astype(np.int64)


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank of the first bit that rows of x and y, pair by pair, share; the width where they share none."""
    both = x & y
    low = np.bitwise_count((both & (~both + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # 64 for an empty word
    some = both != 0
    at = some.argmax(1)
    return np.where(some.any(1), at * 64 + low[np.arange(len(x)), at], 64 * x.shape[1])


def _dealt(df: DataFrame, emit, lists: dict[int, tuple[int, int]], side: int, both: bool) -> DataFrame:
    """Rows (list, i, j, side, id, words, bound) of every list that emit names for a row, one for every pair of blocks it is in.

    lists: how many blocks each list has on the left and the right. both: the two sides are one table.
    """
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                where, which, words = emit(part)  # rows, their lists, packed words of all rows
                if not len(where):
                    continue
                n = np.array([lists.get(int(r), (0, 0)) for r in which], np.int64).reshape(-1, 2)
                ok = (n > 0).all(1)
                where, which, n = where[ok], which[ok], n[ok]
                mine = part["h"].to_numpy()[where] % np.maximum(n[:, side], 1)
                times = n[:, 1 - side]
                other = np.concatenate([np.arange(t) for t in times]) if len(times) else np.empty(0, np.int64)
                rep = np.repeat(np.arange(len(where)), times)
                i, j = (mine[rep], other) if side == 0 else (other, mine[rep])
                if both:
                    i, j = np.minimum(i, j), np.maximum(i, j)
                rows = where[rep]
                if len(rows):
                    yield pd.DataFrame({"list": which[rep], "i": i, "j": j, "side": side, "id": part["id"].to_numpy()[rows], "words": list(words[rows]), "bound": part["bound"].to_numpy()[rows]})

    return df.mapInPandas(run, f"list long, i long, j long, side int, id {kind}, words array<long>, bound double")


def _hashed(df: DataFrame) -> DataFrame:
    have = df if "bound" in df.columns else df.withColumn("bound", F.lit(0.0))
    return have.select("id", "words", "bound", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h"))


def _blocks(n: int) -> int:
    return max(1, -(-n // BLOCK))


def pairs_met(left: dict[int, int], right: dict[int, int]) -> int:
    """How many pairs two lists of these lengths for each bit put beside each other."""
    return sum(n * right.get(r, 0) for r, n in left.items())


def lists_of(df: DataFrame, ranks: Ranking, threshold: float) -> dict[int, int]:
    """Lengths of the lists of the index for a threshold."""
    return {r: n for r, n in _counts(df, lambda w, _: prefix_of(ranks.ranked(w), threshold).sum(0, dtype=np.int64)).items() if r != ALL}


def early(threshold: float) -> float:
    """The share of its bits that the smaller one of two rows this similar has in common with the other, at least."""
    return 2 * threshold / (1 + threshold)


def similar(fp: DataFrame, threshold: float, met=None) -> DataFrame:
    """(a, b, similarity) with a < b of all fingerprints (id, words) of at least this similarity; empty ones are like nothing.

    met: an accumulator that counts the pairs whose bits are compared.
    """
    fp = fp.where(F.exists("words", lambda w: w != 0))
    ranks, kind = ranking(fp), fp.schema["id"].dataType.simpleString()
    if ranks is None:
        return fp.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    lengths, n = lists_of(fp, ranks, threshold), ranks.n
    dense = pairs_met(lists_of(fp, ranks, early(threshold)), lengths) >= n * (n - 1)
    if dense:
        lengths = {ALL: n}

    blocks = {r: (_blocks(m), _blocks(m)) for r, m in lengths.items()}

    def emit(part: pd.DataFrame):
        bits = ranks.ranked(_matrix(part["words"]))
        if dense:
            return np.arange(len(part)), np.full(len(part), ALL), ranks.pack(bits)
        where, which = np.nonzero(prefix_of(bits, threshold))
        return where, which, ranks.pack(bits)

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, at = int(pdf["i"].iat[0]), int(pdf["j"].iat[0]), int(pdf["list"].iat[0])
        block = pdf["h"].to_numpy() % blocks[at][0]
        words, own = _matrix(pdf["words"]), pdf["id"].to_numpy()
        size, left_of = np.bitwise_count(words).sum(1).astype(np.int64), behind(words, at)
        order, share, least = np.argsort(size, kind="stable"), threshold / (1 + threshold), early(threshold)
        rows = [order[block[order] == k] for k in (i, j)]
        out = []
        for lo in range(0, len(rows[0]), STRIP):
            x = rows[0][lo : lo + STRIP]
            y = rows[1][slice(*np.searchsorted(size[rows[1]], [size[x[0]] * threshold - EPS, size[x[-1]] / threshold + EPS]))]  # others have too few bits or too many
            if not len(y):
                continue
            if words.shape[1] <= FEW_WORDS:  # bits of all pairs are counted sooner than pairs are told apart
                both = sum(np.bitwise_count(words[x, k][:, None] & words[y, k][None, :]).astype(np.int16) for k in range(words.shape[1]))
                r, c = np.nonzero(both >= np.ceil(np.arange(2 * 64 * FEW_WORDS + 1) * share - EPS).astype(np.int16)[size[x][:, None] + size[y][None, :]])
                u, v, both = x[r], y[c], both[r, c].astype(np.int64)
                s = both / (size[u] + size[v] - both)
                ok = (s >= threshold - EPS) & ((own[u] < own[v]) | (i != j))
                if met is not None:
                    met.add(len(x) * len(y))
                if at >= 0:
                    ok[ok] = first_shared(words[u[ok]], words[v[ok]]) == at
                s, u, v = s[ok], own[u[ok]], own[v[ok]]
                out.append(pd.DataFrame({"a": np.where(u < v, u, v), "b": np.where(u < v, v, u), "similarity": s}))
                continue
            a, b = size[x][:, None], size[y][None, :]
            p, q = left_of[x][:, None], left_of[y][None, :]
            may = (np.minimum(p, q) >= (a + b) * share - EPS) & (((a <= b) & (p >= a * least - EPS)) | ((b <= a) & (q >= b * least - EPS)))
            if i == j:
                may &= own[x][:, None] < own[y][None, :]
            r, c = np.nonzero(may)
            if met is not None:
                met.add(len(r))
            for k in range(0, len(r), BLOCK * 16):
                u, v = x[r[k : k + BLOCK * 16]], y[c[k : k + BLOCK * 16]]
                both = np.bitwise_count(words[u] & words[v]).sum(1).astype(np.int64)
                s = both / (size[u] + size[v] - both)
                ok = s >= threshold - EPS
                if at >= 0:
                    ok[ok] = first_shared(words[u[ok]], words[v[ok]]) == at
                u, v = own[u[ok]], own[v[ok]]
                out.append(pd.DataFrame({"a": np.where(u < v, u, v), "b": np.where(u < v, v, u), "similarity": s[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []}, dtype=object)

    dealt = _dealt(_hashed(fp), emit, blocks, 0, True).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    return dealt.groupBy("list", "i", "j").applyInPandas(unit, f"a {kind}, b {kind}, similarity double")


def _best_of(ids, words: np.ndarray, refs: np.ndarray, others: np.ndarray, exclude_self: bool, bound: np.ndarray | None = None, rank: int = ALL, met=None) -> pd.DataFrame:
    """(id, ref, similarity): the best of others, which come by refs, for each row of words; with bounds, only where it reaches them.

    rank: of a bit that all rows share, and that is the first one that those pairs share which are not met elsewhere.
    """
    best, at = np.full(len(words), -1.0), np.zeros(len(words), np.int64)
    size, left_of = np.bitwise_count(words).sum(1).astype(np.int64), behind(words, rank)
    sizes, left_of_others = np.bitwise_count(others).sum(1).astype(np.int64), behind(others, rank)
    for lo in range(0, len(words), STRIP):
        rows = slice(lo, lo + STRIP)
        if bound is None:
            s = similarities(words[rows], others)
            if exclude_self:
                s = np.where(ids[rows, None] == refs[None, :], -1.0, s)
        else:
            a, b, t = size[rows, None], sizes[None, :], bound[rows, None]
            may = (np.minimum(left_of[rows, None], left_of_others[None, :]) * (1 + t) >= t * (a + b) - EPS) & (a * t <= b + EPS) & (b * t <= a + EPS)
            if exclude_self:
                may &= ids[rows, None] != refs[None, :]
            r, c = np.nonzero(may)
            s = np.full(may.shape, -1.0)
            for k in range(0, len(r), BLOCK * 16):
                u, v = r[k : k + BLOCK * 16], c[k : k + BLOCK * 16]
                both = np.bitwise_count(words[lo + u] & others[v]).sum(1).astype(np.int64)
                s[u, v] = both / (size[lo + u] + sizes[v] - both)
            if met is not None:
                met.add(len(r))
        at[rows], best[rows] = s.argmax(1), s.max(1)
    if bound is None and met is not None:
        met.add(len(words) * len(others))
    found = best >= 0
    return pd.DataFrame({"id": ids[found], "ref": refs[at[found]], "similarity": best[found]})


def _search(left: DataFrame, right: DataFrame, lists: dict[int, tuple[int, int]], mine, theirs, exclude_self: bool, bounded: bool = False, met=None) -> DataFrame:
    """The best of each left row in each unit it meets."""
    kinds = [df.schema["id"].dataType.simpleString() for df in (left, right)]

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("rid", kind="stable")
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "ref": [], "similarity": []}, dtype=object)
        bound = a["bound"].to_numpy() if bounded else None
        return _best_of(a["lid"].to_numpy(a_kind), _matrix(a["words"]), b["rid"].to_numpy(b_kind), _matrix(b["words"]), exclude_self, bound, int(pdf["list"].iat[0]), met)

    a_kind, b_kind = (np.int64 if k in ("int", "bigint", "smallint", "tinyint") else object for k in kinds)  # a side's ids are null on the other
    l = _dealt(_hashed(left), mine, lists, 0, False).withColumnRenamed("id", "lid").withColumn("rid", F.lit(None).cast(kinds[1]))
    r = _dealt(_hashed(right), theirs, lists, 1, False).withColumnRenamed("id", "rid").withColumn("lid", F.lit(None).cast(kinds[0]))
    return l.unionByName(r).groupBy("list", "i", "j").applyInPandas(unit, f"id {kinds[0]}, ref {kinds[1]}, similarity double")


def _best(found: DataFrame) -> DataFrame:
    """The best of what was found of each id, the smallest ref on ties."""
    order = F.min(F.struct((-F.col("similarity")).alias("s"), "ref"))
    return found.groupBy("id").agg(order.alias("b")).select("id", "b.ref", (-F.col("b.s")).alias("similarity"))


def nearest(left: DataFrame, right: DataFrame, exclude_self: bool = False, met=None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, ref, similarity) of the left fingerprints (id, words): the most similar right one, the smallest ref on ties.

    With nothing in common with anyone, the smallest ref at 0. Up to broadcast_rows references are compared where the left rows
    are. met: an accumulator that counts the pairs whose bits are compared in a search by index.
    """
    kinds = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    schema = f"id {kinds[0]}, ref {kinds[1]}, similarity double"
    few = right.limit(broadcast_rows + 1).toPandas() if broadcast_rows else None
    if few is not None and len(few) <= broadcast_rows:
        few = few.sort_values("id", kind="stable")
        shared = left.sparkSession.sparkContext.broadcast((few["id"].to_numpy(), _matrix(few["words"]) if len(few) else None))

        def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            refs, others = shared.value
            for pdf in batches:
                if len(pdf) and others is not None:
                    yield _best_of(pdf["id"].to_numpy(), _matrix(pdf["words"]), refs, others, exclude_self)

        return left.select("id", "words").mapInPandas(here, schema)
    ranks = ranking(right)
    if ranks is None:
        return left.sparkSession.createDataFrame([], schema)
    held = np.array([r in ranks.frequency for r in range(ranks.width)], np.uint8)

    def firsts(bits: np.ndarray) -> np.ndarray:
        have = bits * held[None, :]
        return (have > 0) & (np.cumsum(have, axis=1, dtype=np.int64) <= FIRST)

    often = np.array([ranks.frequency.get(r, 0) for r in range(ranks.width)], np.int64)

    def rest(bits: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits left to look up, and the rows whose lists hold so much that they rather meet every reference once."""
        more = prefix_of(bits, bound) & (held[None, :] > 0) & ~firsts(bits)
        whole = more @ often >= ranks.n
        return more & ~whole[:, None], whole

    def emitter(chosen):
        def emit(part: pd.DataFrame):
            bits = ranks.ranked(_matrix(part["words"]))
            bound = part["bound"].to_numpy()
            where, which = chosen(bits, bound)
            return where, which, ranks.pack(bits)

        return emit

    def rest_lists(bits: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        more, whole = rest(bits, bound)
        where, which = np.nonzero(more)
        return np.append(where, np.flatnonzero(whole)), np.append(which, np.full(whole.sum(), ALL))

    looked = _counts(left, lambda w, _: firsts(ranks.ranked(w)).sum(0, dtype=np.int64))
    n_left, n_right = looked.pop(ALL), ranks.n
    blocks = lambda a, b: {r: (_blocks(n), _blocks(b[r])) for r, n in a.items() if r in b}
    if 4 * pairs_met(looked, ranks.frequency) >= n_left * n_right:  # dense: the second round would look further than the first
        one = emitter(lambda bits, bound: (np.arange(len(bits)), np.full(len(bits), ALL)))
        return _best(_search(left, right, blocks({ALL: n_left}, {ALL: n_right}), one, one, exclude_self, False, met))
    all_bits = emitter(lambda bits, bound: np.nonzero(bits))
    seed = cut(_best(_search(left, right, blocks(looked, ranks.frequency), emitter(lambda bits, bound: np.nonzero(firsts(bits))), all_bits, exclude_self, False, met)))
    bounded = cut(left.join(seed.select("id", F.col("similarity").alias("bound")), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))))

    def tally(words: np.ndarray, bound: np.ndarray) -> np.ndarray:
        more, whole = rest(ranks.ranked(words), bound)
        return np.append(more.sum(0, dtype=np.int64), whole.sum())

    again = _counts(bounded, tally)
    again.pop(ALL)
    lengths = dict(ranks.frequency)
    if n := again.pop(ranks.width, 0):  # the place behind the last bit
        again[ALL], lengths[ALL] = n, n_right
    theirs = emitter(lambda bits, bound: tuple(np.append(x, y) for x, y in zip(np.nonzero(bits), (np.arange(len(bits)), np.full(len(bits), ALL)))))
    more = _search(bounded, right, blocks(again, lengths), emitter(rest_lists), theirs, exclude_self, True, met)
    got = seed.unionByName(more)
    two = [r["id"] for r in right.select("id").orderBy("id").limit(2).collect()]  # what a row that shares no bit with anyone gets
    ref = F.when(F.col("id") == two[0], F.lit(two[1] if len(two) > 1 else None)).otherwise(F.lit(two[0])) if exclude_self else F.lit(two[0])
    lone = left.join(got.select("id").distinct(), "id", "left_anti").select("id", ref.cast(kinds[1]).alias("ref"), F.lit(0.0).alias("similarity")).where("ref IS NOT NULL")
    return _best(got.unionByName(lone))

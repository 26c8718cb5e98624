"""Tanimoto similarity of packed fingerprints, nearest neighbours and diverse subsets.

Thresholded joins and searches for the nearest go by an inverted index over the rarest set bits (bitindex), over distinct
fingerprints. The full matrix, whose size is that of its result, visits a right side dealt to blocks; one under a checked size is
broadcast instead. Fingerprints are (id, word, bits), word being one 64-bit number or an array of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import bitindex

#: rows of a right side that may be broadcast
BROADCAST_ROWS = 100_000
BLOCKS = 16


def tanimoto(a: Column, b: Column, bits_a: Column, bits_b: Column) -> Column:
    """NULL when a fingerprint is missing; 0 for two empty ones."""
    shared = F.bit_count(a.bitwiseAND(b))
    whole = bits_a + bits_b - shared
    return F.when(whole > 0, shared / whole).when(whole == 0, 0.0)


def likeness(word: Column, given: int | list[int]) -> Column:
    """Similarity of a fingerprint, one word or an array of them, to one that is at hand; 0 for two empty ones."""
    words, given = (word, given) if isinstance(given, list) else (F.array(word.cast("long")), [given])
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    shared = total(F.zip_with(words, F.array(*[F.lit(x).cast("long") for x in given]), lambda x, y: F.bit_count(x.bitwiseAND(y))))
    whole = total(F.transform(words, F.bit_count)) + sum((x & (1 << 64) - 1).bit_count() for x in given) - shared
    return F.when(whole > 0, shared / whole).otherwise(0.0)


def every_pair(left: DataFrame, right: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Each left row with each right row; columns must not clash."""
    if len(right.take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        return left.crossJoin(F.broadcast(right))
    cols = [c for c in right.columns]
    dealt = right.withColumn("__b", F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int"))
    return left.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "__b").drop("__b")


def matrix(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, ref, similarity) of every pair; a missing fingerprint on the left gives -1, on the right no row."""
    l, r = left.select(F.col("id"), F.col("word").alias("wa"), F.col("bits").alias("na")), right.where("word IS NOT NULL").select(F.col("id").alias("ref"), F.col("word").alias("wb"), F.col("bits").alias("nb"))
    return every_pair(l, r).select("id", "ref", F.coalesce(tanimoto(F.col("wa"), F.col("wb"), F.col("na"), F.col("nb")), F.lit(-1.0)).alias("similarity"))


def nearest(left: DataFrame, right: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(id, ref, similarity): the most similar reference, the lowest id on ties; -1 and no reference without a fingerprint or a reference."""
    mine, refs = bitindex.packed(left), bitindex.packed(right)
    if not exclude_self:
        refs = bitindex.distinct_words(refs)  # copies answer by their lowest id
    best = bitindex.nearest(mine, refs, exclude_self)
    return left.select("id").join(best, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(-1.0)))


def similar_pairs(fp: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) with a < b and similarity >= threshold; empty and missing fingerprints are in no pair."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return bitindex.similar(bitindex.packed(fp), threshold)


def novelty(nearest_: DataFrame, known: DataFrame, exact_key: str = "word", threshold: float = 0.85) -> DataFrame:
    """(id, is_exact, similarity, ref, is_novel, band): known words make exact matches; -1 (nothing to compare) is not novel."""
    keys = known.select(exact_key).distinct().withColumn("__known", F.lit(True))
    df = nearest_.join(keys, exact_key, "left").withColumn("is_exact", F.coalesce("__known", F.lit(False)))
    ok = ~F.col("is_exact") & (F.col("similarity") >= 0) & (F.col("similarity") < threshold)
    band = F.when(F.col("is_exact"), "exact").when(F.col("similarity") < 0, "unknown").when(F.col("similarity") >= threshold, "near").when(F.col("similarity") >= 0.4, "analogue").otherwise("distant")
    return df.select("id", "is_exact", "similarity", "ref", ok.alias("is_novel"), band.alias("band"))


def mark_known(df: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """df with is_known: whether its key is among the known ones; a NULL key is not."""
    keys = known.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__k", F.lit(True))
    return df.join(keys, key, "left").withColumn("is_known", F.coalesce("__k", F.lit(False))).drop("__k")


def diverse_subset(fp: DataFrame, threshold: float) -> DataFrame:
    """(id): kept in id order iff no kept smaller id is as similar as threshold; rows without a fingerprint are skipped.

    Copies go first: of equal fingerprints only the lowest id can be kept, unless they are empty, which are like nothing.
    """
    rows = bitindex.packed(fp)
    empty = ~F.exists("words", lambda w: w != 0)
    one = cut(bitindex.distinct_words(rows.where(~empty)).select("id", "words"))
    kept = first_independent(one.select("id"), bitindex.similar(one, threshold).select("a", "b"))
    return kept.unionByName(rows.where(empty).select("id"))


#: edges that one task settles at once
CELL = 500_000


def first_independent(ids: DataFrame, pairs: DataFrame, cell: int = CELL) -> DataFrame:
    """The lexicographically first maximal independent set of (id) under edges (a, b), a < b.

    Vertices are dealt to cells of consecutive ids with about `cell` edges into them. A cell's task goes through its edges in order and
    decides every vertex whose smaller neighbours are decided or in the cell and decided before it; what hangs on another
    cell waits for the next round, whose cells are dealt anew over what is left. The first cell is always decided whole, so every
    round ends more than it began, and what fits into one cell ends in it: a chain of any length up to `cell` edges takes one round. A
    task streams its edges and holds a state a vertex of its cell.
    """
    kind = ids.schema["id"].dataType.simpleString()
    live, out = cut(pairs.select("a", "b").where("a < b").distinct()), None

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}  # of this cell's vertices: 1 kept, 0 out, -1 waits for another cell
        now, found = None, set()
        said = lambda: 0 if 1 in found else -1 if -1 in found else 1
        for pdf in batches:
            for a, b, root in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["root"].tolist()):
                if b != now:
                    if now is not None:
                        state[now] = said()
                    now, found = b, set()
                found.add(1 if root else state.get(a, -1))
        if now is not None:
            state[now] = said()
        yield pd.DataFrame({"id": list(state), "s": list(state.values())}, dtype=object)

    while n := live.count():
        waiting = live.select(F.col("b").alias("a"), F.lit(True).alias("waits")).distinct()
        edges = live.join(waiting, "a", "left").select("a", "b", F.col("waits").isNull().alias("root"))  # a root is known to be kept
        edges = edges.repartitionByRange(max(1, -(-n // cell)), "b").sortWithinPartitions("b", "a")
        known = cut(edges.mapInPandas(settle, f"id {kind}, s int").where("s >= 0"))
        lost = known.where("s = 0").select("id")
        out = lost if out is None else out.unionByName(lost)
        live = cut(live.join(known.select(F.col("id").alias("b")), "b", "left_anti").join(lost.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b"))
    return ids if out is None else ids.join(out, "id", "left_anti")

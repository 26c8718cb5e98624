"""Shared plumbing of the corpus operators: scratch storage, byte hashing, block units, components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut, ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives memory that a finished task no longer uses back to the system: idle Python workers stay in their executors."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInPandas or mapInArrow, with trim() at the end of each task."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        trim()

    return run


_USER, _FORGET = "", []


def turn_to(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Says what a Python worker works on now. One that turns to another operator drops what the last remembered."""
    global _USER
    if operator != _USER:
        while _FORGET:
            _FORGET.pop()()
        _USER = operator
        if forget:
            _FORGET.append(forget)


# ---------------------------------------------------------------- byte hashing

_RNG = np.random.default_rng(20260101)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
ROOT = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """ROOT**i (or its inverse) modulo 2**64 for i < n; grown by doubling and kept."""
    key = "inv" if inverse else "pow"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = pow(int(ROOT), -1, 1 << 64) if inverse else int(ROOT)
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled, step = 1, base
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * np.uint64(step)
            step = step * step % (1 << 64)
            filled *= 2
        _POWERS[key] = have
    return have[:n]


class Rolling:
    """Hashes of any substring of a byte buffer from one prefix sum, modulo 2**64."""

    def __init__(self, buf: np.ndarray, salt: int = 0):
        code = BYTE_CODE if not salt else mix(BYTE_CODE + np.uint64(salt))
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code[buf] * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, inverse=True)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.back[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- rows in small slices

#: rows converted from Arrow at once; rows of an Arrow batch between the JVM and Python
ROWS, BATCH = 256, 1000


def small_batches(df: DataFrame) -> None:
    """Bounds the session's Arrow batches: with long texts, the default of 10,000 rows is tens of MB of off-heap memory a task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > BATCH or int(conf.get(name)) <= 0:
        conf.set(name, str(BATCH))


def map_small(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], ddl: str) -> DataFrame:
    """mapInPandas over slices of ROWS rows: Arrow batches of long texts are never converted whole."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    yield batch.slice(at, ROWS).to_pandas(integer_object_nulls=True)

        for pdf in f(slices()):
            if len(pdf):
                yield pa.RecordBatch.from_pandas(pdf, schema, preserve_index=False)

    return df.mapInArrow(trimmed(run), ddl)


def keep_rows(df: DataFrame, column: str, start: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of df, all columns untouched, whose text in column passes the test that start() makes for a task."""

    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array([passes(t) for t in part.column(column).to_pylist()], pa.bool_()))

    return df.mapInArrow(trimmed(run), df.schema)


# ---------------------------------------------------------------- grouped streams

def grouped(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches whose rows arrive sorted by key; a group may span batches."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in key:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [len(pdf)]])
        for a, b in zip(starts[:-1], starts[1:]):
            part = pdf.iloc[a:b]
            now = tuple(part[k].iat[0] for k in key)
            if held and now != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            last = now
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def grouped_arrays(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """grouped(), with each group as arrays by column: what many small groups need."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    put = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
    for pdf in batches:
        if not len(pdf):
            continue
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(len(pdf), bool)
        for k in key:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [len(pdf)]]).tolist()
        for a, b in zip(starts[:-1], starts[1:]):
            now = tuple(columns[k][a] for k in key)
            if held and now != last:
                yield put()
                held = []
            held.append({c: v[a:b] for c, v in columns.items()})
            last = now
    if held:
        yield put()


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest (root, member) of a symmetric boolean matrix."""
    n = len(adjacent)
    unseen = np.ones(n, bool)
    edges = []
    for root in np.flatnonzero(adjacent.any(1)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            reach = adjacent[queue].any(0) & unseen
            queue = np.flatnonzero(reach).tolist()
            unseen[queue] = False
            edges += [(root, x) for x in queue]
    return edges


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component) for every vertex of edges(u, v); component is the smallest id it can reach.

    Random-priority contraction: each round every vertex joins the neighbour (or itself) with the lowest
    hash, and edges between joined vertices vanish. Edge counts fall by a constant factor a round, whatever
    the shape; no vertex's neighbourhood is gathered anywhere (only minima are). Each round is written to the
    shared scratch folder. Null endpoints and self loops are ignored; an empty input gives no rows.
    """
    spark = edges.sparkSession
    live = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("to"))
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best")).select(F.col("u").alias("id"), F.least("best", rank(F.col("u")))["to"].alias("to"))
        moved = cut(moved)
        maps.append(moved)
        a, b = moved.select(F.col("id").alias("u"), F.col("to").alias("a")), moved.select(F.col("id").alias("v"), F.col("to").alias("b"))
        live = cut(live.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    else:
        raise RuntimeError("components did not converge")
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    # compose from the last map back to the first: where each vertex ends
    ends = maps[-1]
    for earlier in reversed(maps[:-1]):
        after = ends.select(F.col("id").alias("to"), F.col("to").alias("end"))
        ends = earlier.join(after, "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    ends = cut(ends)
    least = ends.groupBy("to").agg(F.min("id").alias("component"))
    return ends.join(least, "to").select("id", "component")

"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation of the principal axes that balances binary codes is learned on a bounded sample. Codes are cut into chunks; each
chunk is a hash table over all vectors, keyed with the label. What goes through the tables are ids and the first 64 bits of the
codes: two vectors that share a bucket are candidates when these differ in few enough bits. Only vectors with a candidate are then
fetched, once for each table that they have one in, and compared by their original components; a pair counts in the first table that
it shares a bucket of, which the codes of the fetched vectors tell.

Two vectors at angle t differ in a bit with probability t/pi for random planes: enough chunks are used to miss a pair at the
threshold with probability MISS at most, and the Hamming radius lies SIGMAS deviations above its mean distance. Learned planes
are not random ones, so recall is measured against all pairs as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, forest, grouped_arrays, small_batches, trimmed

COSINE, MISS, SIGMAS = 0.93, 0.02, 4
#: vectors of the fit; iterations of it; vectors of a block; vectors wanted in an average bucket
SAMPLE, ITERATIONS, BLOCK, BUCKET = 8_000, 30, 256, 32


def learn(x: np.ndarray, seed: int) -> np.ndarray:
    """[d, d] projection whose signs are the code: principal axes, then a rotation by ITQ."""
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)))
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(ITERATIONS):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, t = np.linalg.svd(v.T @ b)
        r = u @ t
    return axes @ r


def shape_of(n_largest: int, dims: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int, int]:
    """(bits a chunk, tables, rotations) for the largest label's number of vectors."""
    bits = max(6, min(24, dims, math.ceil(math.log2(max(2, n_largest) / BUCKET))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    tables = max(4, math.ceil(math.log(miss) / math.log(1 - same)))
    return bits, tables, -(-tables // max(1, dims // bits))


def sent(n_largest: int, dims: int, cosine: float = COSINE) -> int:
    """Bytes of a vector that go through the tables: id, label, dimensions, table, key and digest of 64 bits for each."""
    return shape_of(n_largest, dims, cosine)[1] * (8 + 4 + 4 + 4 + 4 + 8)


def unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision, and which are usable (equal lengths are the caller's affair)."""
    x = np.array(vectors, np.float64)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(x, axis=1)
        big = ~np.isfinite(norm) & np.isfinite(x).all(1)
        if big.any():
            x[big] /= np.abs(x[big]).max(1, keepdims=True)
            norm[big] = np.linalg.norm(x[big], axis=1)
        small = (norm == 0) & (x != 0).any(1)
        if small.any():
            x[small] /= np.abs(x[small]).max(1, keepdims=True)
            norm[small] = np.linalg.norm(x[small], axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        return x / np.where(ok, norm, 1)[:, None], ok


def radius_of(bits: int, cosine: float = COSINE) -> int:
    """The Hamming distance up to which codes of so many bits are candidates."""
    p = math.acos(cosine) / math.pi
    return min(bits, math.ceil(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p))))


def hamming(codes: np.ndarray) -> np.ndarray:
    """Distances of all pairs of packed codes [n, words of 64 bits]."""
    out = np.zeros((len(codes), len(codes)), np.int32)
    for k in range(codes.shape[1]):
        out += np.bitwise_count(codes[:, k][:, None] ^ codes[:, k][None, :])
    return out


def _matrix(column, kind: str) -> np.ndarray:
    """[rows, values] of equally long binaries."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _fresh(unit: dict[str, np.ndarray]) -> np.ndarray:
    """Which pairs of a unit are its own to judge: those that share no bucket of an earlier table; across sides, if two blocks meet."""
    n, table = len(unit["vec_id"]), int(unit["table"][0])
    mine = ~np.eye(n, dtype=bool)
    if table:
        keys = unit["keys"]
        for t in range(table):
            mine &= keys[:, t][:, None] != keys[:, t][None, :]
    if unit["i"][0] != unit["j"][0]:
        mine &= unit["block"][:, None] != unit["block"][None, :]
    return mine


UNIT = ["d", "label", "table", "key"]


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (with UNIT) of buckets of two vectors or more, in units of two blocks of a bucket, sorted; a bucket's blocks meet pairwise."""
    crowd = rows.groupBy(*UNIT).agg(F.count("*").alias("size")).where("size > 1").select(*UNIT, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    crowd = cut(crowd)  # apart from it, adaptive execution can split the join of a bucket's many rows
    units = rows.join(crowd, UNIT).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    return units.repartition(*UNIT, "i", "j").sortWithinPartitions(*UNIT, "i", "j", "vec_id")


def links(vectors: DataFrame, wide: int, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """((vec_id, n_links) in parts, (u, v) edges) between distinct vectors (vec_id, label, embedding, n); embedding: floats of `wide` bytes."""
    spark, kind = vectors.sparkSession, f"<f{wide}"
    length = (F.octet_length("embedding") / wide).cast("int")
    sizes = vectors.groupBy(length.alias("d"), "label").agg(F.count("*").alias("n"))
    per_dim = {r["d"]: (r["n"], r["all"]) for r in sizes.groupBy("d").agg(F.max("n").alias("n"), F.sum("n").alias("all")).collect()}
    plans = {}
    for d, (n, total) in per_dim.items():
        bits, tables, rotations = shape_of(n, d, cosine)
        rate = min(1.0, SAMPLE / total)
        some = vectors.where((length == d) & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < rate * (1 << 20))).select("vec_id", "embedding").collect()
        x = unit([np.frombuffer(r["embedding"], kind) for r in sorted(some, key=lambda r: r["vec_id"])])[0] if some else np.eye(d)
        plans[d] = (bits, tables, [learn(x, s) for s in range(rotations)])
    shared = spark.sparkContext.broadcast(plans)

    def coded(x: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys of all tables, the first 64 bits of the code) of unit vectors."""
        bits, tables, maps = shared.value[d]
        on, per = np.concatenate([x @ m >= 0 for m in maps], 1), max(1, d // bits)
        keys = np.empty((len(x), tables), "<i4")
        for t in range(tables):
            part = on[:, (t // per) * d + (t % per) * bits :][:, : min(bits, d)]
            keys[:, t] = part @ (1 << np.arange(part.shape[1]))
        head = on[:, :64]
        return keys, np.packbits(np.pad(head, ((0, 0), (0, 64 - head.shape[1]))), axis=1).view("<i8")[:, 0]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = np.array([len(v) // wide for v in pdf["embedding"]])
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                keys, digest = coded(unit(_matrix(pdf["embedding"].iloc[rows], kind))[0], d)
                for t in range(keys.shape[1]):
                    yield pd.DataFrame({"vec_id": pdf["vec_id"].iloc[rows], "label": pdf["label"].iloc[rows], "d": np.int32(d), "table": np.int32(t), "key": keys[:, t], "digest": digest})

    label = f"label {vectors.schema['label'].dataType.simpleString()}"
    columns = ["vec_id", "d", "label", "table", "key"]
    spread = cut(vectors.select("vec_id", "label", "embedding").mapInPandas(trimmed(encode), f"vec_id long, {label}, d int, table int, key int, digest long"))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for unit in grouped_arrays(batches, [*UNIT, "i", "j"]):
            near = hamming(unit["digest"].view(np.uint64)[:, None]) <= radius_of(min(64, int(unit["d"][0])), cosine)
            np.fill_diagonal(near, False)
            if unit["i"][0] != unit["j"][0]:
                near &= unit["block"][:, None] != unit["block"][None, :]
            some = np.flatnonzero(near.any(1))
            if len(some):
                out.append({c: unit[c][some] for c in columns})
                held += len(some)
            if held > 20_000:
                yield pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in columns})
                out, held = [], 0
        if out:
            yield pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in columns})

    met = _dealt(spread).mapInPandas(trimmed(candidates), f"vec_id long, d int, {label}, table int, key int").distinct()
    opened = cut(met).join(vectors.select("vec_id", "embedding", "n"), "vec_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, edges = [], []
        for group in grouped_arrays(batches, [*UNIT, "i", "j"]):
            x = unit(_matrix(group["embedding"], kind))[0]
            near = x @ x.T >= cosine
            if near.sum() > len(near):  # keys are cut from the vectors that are here, not sent
                group["keys"] = coded(x, int(group["d"][0]))[0] if group["table"][0] else None
                near &= _fresh(group)
            else:
                near[:] = False
            ids, n = group["vec_id"], near @ group["n"]
            hit = np.flatnonzero(n)
            counts += [(x, None, n) for x, n in zip(ids[hit].tolist(), n[hit].tolist())]
            edges += [(int(ids[a]), int(ids[b]), None) for a, b in forest(near)]
            if len(counts) > 50_000:
                yield pd.DataFrame(counts + edges, columns=["u", "v", "n"]).astype("Int64")
                counts, edges = [], []
        yield pd.DataFrame(counts + edges, columns=["u", "v", "n"]).astype("Int64")

    found = cut(_dealt(opened).mapInPandas(trimmed(compare), "u long, v long, n long"))
    return found.where("v IS NULL").select(F.col("u").alias("vec_id"), F.col("n").alias("n_links")), found.where("v IS NOT NULL").select("u", "v")


def packed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, data, h) of every row: its components as one binary and 128 bits that stand for them; null where it can link with nothing."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    small_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for v in batch.column(2).to_numpy(zero_copy_only=False):
                v = None if v is None else np.asarray(v, kind)
                data.append((v + v.dtype.type(0)).tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)  # no negative zero
            names = [None if d is None else xxhash.xxh3_128_digest(d) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(names, pa.binary())], ["vec_id", "label", "data", "h"])

    label = f"label {rows.schema['label'].dataType.simpleString()}"
    return rows.mapInArrow(trimmed(run), f"vec_id long, {label}, data binary, h binary")


def dedup(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; links join equal, non-null labels at cosine or more.

    Null vectors, zero vectors and vectors with a null or non-finite component link with nothing, nor do vectors of
    different lengths. Equal vectors of a label are found by 128-bit digests of their values and compared once, for all. Repeated
    rows of one vec_id are vectors that link with each other but not with themselves: each row counts in the others' n_links and
    gives a row of its own. A null vec_id links with nothing. An empty table gives no rows.
    """
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    base = cut(packed(embeddings))
    fine = F.col("h").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    usable = base.where(fine)
    same = cut(usable.groupBy("label", "h").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("data").alias("embedding")))
    counts, edges = links(same.select("vec_id", "label", "embedding", "n"), 4 if single else 8, cosine)
    per_rep = counts.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    ends = components(edges).withColumnRenamed("id", "vec_id")
    reps = same.join(per_rep, "vec_id", "left").join(ends, "vec_id", "left").select("label", "h", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    member = usable.select("vec_id", "label", "h").join(cut(reps), ["label", "h"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

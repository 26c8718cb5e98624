"""Exact Jaccard joins of word shingles with a token-group matrix.

Documents are partitioned into groups of likely similar ones: of near size, and with one first token in common - the
first of their rare tokens, or, where frequent tokens dominate (families of many copies, shared passages), the first
of the least frequent of those, which copies keep. The matrix holds, for every
token of a document's prefix, the groups whose token union has it. Two groups qualify when their unions share enough prefix
tokens: for similarity t, two sets of which one has n tokens share at least ceil(t n), so their first
n - ceil(t n) + DEPTH tokens in any common order share DEPTH of them; the union's count bounds that of each member
pair. Only qualifying groups are opened and their members compared exactly. Nothing is lost: the order of tokens (rare
before frequent) and the groups only decide how much is opened.

Equal sets are compared once. Groups are opened in blocks, so no task gets an unbounded group; a result is one row per
document, and links inside a block leave as a spanning forest. Members of large groups meet a few of their own first, and only
what that has not connected meets block by block, so a family of near copies costs time in proportion to its size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, forest, grouped, map_small, mix, Rolling, shuffle_parts, trimmed, turn_to

WORDS, PERCENT = 4, 85
#: shared prefix tokens asked of two groups; members opened at once on a side
DEPTH, BLOCK = 8, 256
#: members of a large group that all of it is compared with first
PIVOTS = 4
#: ids (eight bytes each) that are broadcast to pick texts before they are exchanged; beyond, the exchange itself picks them
LOOKUP = 500_000
#: tokens in so many documents go last in the order; so many of them, the most frequent, are remembered (an order needs no more)
HOT, HOT_KEPT = 24, 2_000_000
#: token hashes below this share of their range are all counted (prefixes rarely reach past it);
#: above it, only what repeats within a task's own COUNT_AT tokens
COUNTED, COUNT_AT = 0.5, 2_000_000
#: share of hot tokens among a set's counted ones from which its group is taken from them
DOMINATED = 0.5
SEGMENT = 1 << 20
U6 = np.uint64((1 << 48) - 1)


def shingle_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, starts): sorted distinct 64-bit shingle hashes of every text in turn, and where each begins (one more at the end)."""
    flat, counts = [], np.zeros(len(texts), np.int64)
    held, total = [], 0

    def flush() -> None:
        nonlocal held, total
        if held:
            ids, tokens = _hashed([b for _, b in held], size)
            np.add.at(counts, np.array([i for i, _ in held])[ids], 1)
            flat.append(tokens)
        held, total = [], 0

    for i, t in enumerate(texts):
        data = b" ".join((t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")).lower().split()) if t else b""
        if data:
            held.append((i, data))
            total += len(data)
            if total > SEGMENT:
                flush()
    flush()
    return np.concatenate(flat) if flat else np.zeros(0, np.uint64), np.r_[0, np.cumsum(counts)]


def _hashed(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n".join(parts), np.uint8)
    roll = Rolling(buf)
    gaps = np.flatnonzero((buf == 32) | (buf == 10))
    start, stop = np.r_[0, gaps + 1], np.r_[gaps, len(buf)]
    doc = np.cumsum(np.r_[False, buf[gaps] == 10])
    n = np.bincount(doc, minlength=len(parts))
    first = np.r_[0, np.cumsum(n)[:-1]]
    place = np.arange(len(doc)) - first[doc]
    lead = np.flatnonzero(place <= np.maximum(n[doc] - size, 0))
    last = np.minimum(lead + size - 1, first[doc[lead]] + n[doc[lead]] - 1)
    tokens, ids = roll.of(start[lead], stop[last]), doc[lead]
    order = np.lexsort((tokens, ids))
    tokens, ids = tokens[order], ids[order]
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])]
    return ids[new], tokens[new]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The rows of one bucket after the other, without the bucket, from batches sorted by it."""
    for group in grouped(batches, ["bucket"]):
        yield list(group.drop(columns="bucket").itertuples(index=False, name=None))


def hot_tokens(docs: DataFrame, size: int, hot: int = HOT, kept: int = HOT_KEPT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted tokens, binary logarithms of their counts) of tokens in `hot` documents at least (the `kept` most frequent).

    Counts are over all documents, summed map-side first.
    """
    buckets = shuffle_parts(docs.sparkSession)
    limit = np.uint64(int(COUNTED * 2**64))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("group_join")

        def flush():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            take = (value < limit) | (n > 1)
            value, n = value[take], n[take]
            bucket = value % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            value, n, bucket = value[order], n[order].astype(np.uint32), bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            return pd.DataFrame([(b, value[edge[b] : edge[b + 1]].tobytes(), zlib.compress(n[edge[b] : edge[b + 1]].tobytes(), 1)) for b in range(buckets) if edge[b + 1] > edge[b]], columns=["bucket", "tokens", "counts"])

        held, total = [], 0
        for pdf in batches:
            tokens, starts = shingle_sets(pdf["text"].tolist(), size)
            held.append(tokens)
            total += len(tokens)
            if total > COUNT_AT:
                yield flush()
                held, total = [], 0
        if total:
            yield flush()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for parts in by_bucket(batches):  # one at a time
            tokens, counts = zip(*((np.frombuffer(t, np.uint64), np.frombuffer(zlib.decompress(n), np.uint32)) for t, n in parts))
            value, at = np.unique(np.concatenate(tokens), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(value))
            yield pd.DataFrame({"token": value[n >= hot].view(np.int64), "n": n[n >= hot].astype(np.int64)})

    found = map_small(_texts(docs).select("text"), count, "bucket int, tokens binary, counts binary").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(trimmed(add), "token long, n long")
    got = found.orderBy(F.desc("n"), "token").limit(kept).toPandas()
    token = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.log2(np.maximum(got["n"].to_numpy(np.int64)[order], 1)).astype(np.uint8)


def _ordered(tokens: np.ndarray, starts: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of every set, rare ones first, by hash among themselves; the token that names the group of every set, no set being empty)."""
    known, level = hot
    if not len(known):
        return tokens, tokens[starts[:-1]]
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    is_hot = known[at] == tokens
    counted = tokens < np.uint64(int(COUNTED * 2**64))
    first = np.where(is_hot & counted, (level[at].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8)), np.uint64(2**64 - 1))
    n_hot, n_all = (np.add.reduceat(x.astype(np.int64), starts[:-1]) for x in (is_hot & counted, counted))
    sorted_ = tokens[np.lexsort((tokens, is_hot, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))]
    return sorted_, np.where((n_hot > 0) & (n_hot >= DOMINATED * n_all), np.minimum.reduceat(first, starts[:-1]), sorted_[starts[:-1]])


def matrix(docs: DataFrame, size: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, a, b, grp) of every document, qualifying (g1, g2) pairs of different groups).

    a and b are a fingerprint of the set; grp is null for an empty one.
    """
    spark = docs.sparkSession
    buckets = shuffle_parts(spark)
    shared = spark.sparkContext.broadcast(hot)
    step = math.log(100 / percent) if percent < 100 else math.inf

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("group_join")

        def flush():
            token, group, band = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((group, token))
            token, group, band = token[order], group[order], band[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])]
            token, group, band = token[new], group[new], band[new]
            bucket = (token >> np.uint64(48)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, edge = bucket[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                some = order[edge[b] : edge[b + 1]]
                if len(some):
                    rows.append((b, _six(token[some]) + _six(group[some]) + band[some].tobytes()))
            return pd.DataFrame({"bucket": [b for b, _ in rows], "data": [d for _, d in rows], "doc_id": pd.array([None] * len(rows), "Int64"), "n": 0, "a": 0, "b": 0, "grp": pd.array([None] * len(rows), "Int64")})

        held, total = [], 0
        for pdf in batches:
            tokens, starts = shingle_sets(pdf["text"].tolist(), size)
            n = np.diff(starts)
            some = np.flatnonzero(n)
            a, b, grp = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), pd.array([None] * len(n), "Int64")
            if len(some):
                a[some] = np.add.reduceat(mix(tokens), starts[some])
                b[some] = np.bitwise_xor.reduceat(mix(tokens + np.uint64(0x1234567)), starts[some])
                tokens, name = _ordered(tokens, np.r_[starts[some], len(tokens)], shared.value)
                band = np.floor(np.log(np.maximum(n, 1)) / step + 1e-9).astype(np.uint8)
                group = np.zeros(len(n), np.uint64)
                group[some] = mix(name ^ mix(band[some].astype(np.uint64))) & U6
                grp[some] = group[some].astype(np.int64)
                least = -(-percent * n // 100)
                take = np.where(pdf["doc_id"].notna(), np.minimum(n, n - least + DEPTH), 0)
                at = np.repeat(starts[:-1] - np.r_[0, np.cumsum(take)[:-1]], take) + np.arange(take.sum())
            if len(some) and len(at):
                held.append((tokens[at], np.repeat(group, take), np.repeat(band, take)))
                total += len(at)
            yield pd.DataFrame({"bucket": pd.array([None] * len(n), "Int32"), "data": None, "doc_id": pdf["doc_id"].astype("Int64"), "n": n, "a": a.view(np.int64), "b": b.view(np.int64), "grp": grp})
            if total > 500_000:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read(d: bytes) -> tuple[np.ndarray, ...]:
            n = len(d) // 13
            return _unsix(d[: 6 * n]), _unsix(d[6 * n : 12 * n]), np.frombuffer(d, np.uint8, n, 12 * n)

        for held in by_bucket(batches):  # one at a time: the rest is still in the sorted exchange
            parts = [read(d) for d, in held]
            token, group, band = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((group, band, token))
            token, group, band = token[order], group[order], band[order].astype(np.int16)
            new = np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])]
            token, group, band = token[new], group[new], band[new]
            head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            count = np.diff(np.r_[head, len(token)])
            head, count = head[count > 1], count[count > 1]
            found, total = [], 0
            for k in np.unique(count):  # tokens with k groups at once
                rows = head[count == k][:, None] + np.arange(k)
                for lo in range(0, len(rows), max(1, 500_000 // (k * k))):
                    r = rows[lo : lo + max(1, 500_000 // (k * k))]
                    for i in range(k - 1):
                        x, y = np.broadcast_to(r[:, i : i + 1], (len(r), k - 1 - i)), r[:, i + 1 :]
                        fits = np.abs(band[x] - band[y]) <= 2
                        u, v = group[x[fits]], group[y[fits]]
                        low = np.minimum(band[x[fits]], band[y[fits]])
                        found.append((np.minimum(u, v), np.maximum(u, v), low))
                        total += len(u)
                    if total > 1_000_000:
                        yield _summed(found)
                        found, total = [], 0
            if found:
                yield _summed(found)

    made = cut(map_small(_texts(docs), build, "bucket int, data binary, doc_id long, n long, a long, b long, grp long"))
    info = made.where("data IS NULL").select("doc_id", "n", "a", "b", "grp")
    pairs = made.where("data IS NOT NULL").select("bucket", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(trimmed(pair), "g1 long, g2 long, shared long, low int")
    # sets of the lower band have so many tokens at least, and so share so many
    least = F.ceil(F.lit(percent / 100) * F.pow(F.lit(100 / percent), F.col("low")) - 1e-3) if step < math.inf else F.lit(1)
    need = F.least(F.lit(DEPTH), F.greatest(F.lit(1), least))
    return info, pairs.groupBy("g1", "g2").agg(F.sum("shared").alias("shared"), F.min("low").alias("low")).where(F.col("shared") >= need).select("g1", "g2")


def _summed(found: list) -> pd.DataFrame:
    u, v, low = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((v, u))
    u, v, low = u[order], v[order], low[order]
    head = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.zeros(0, np.int64)
    return pd.DataFrame({"g1": u[head].astype(np.int64), "g2": v[head].astype(np.int64), "shared": np.diff(np.r_[head, len(u)]), "low": (np.minimum.reduceat(low, head) if len(head) else low).astype(np.int32)})


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def similar(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """Boolean matrix of pairs (across sides, if given) with percent or more of Jaccard similarity."""
    n, size = len(sets), np.array([len(s) for s in sets])
    ok = size[:, None] * percent <= 100 * size[None, :]
    ok = ok & ok.T
    if side is not None:
        ok &= side[:, None] != side[None, :]
    np.fill_diagonal(ok, False)
    if n <= 12:
        for i in range(n):
            for j in range(i + 1, n):
                if ok[i, j]:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    ok[i, j] = ok[j, i] = 100 * shared >= percent * (size[i] + size[j] - shared)
        return ok
    if not ok.any():
        return ok
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    wide = int(column.max()) + 1
    shared, chunk = np.zeros((n, n), np.float32), max(1, 4_000_000 // n)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, wide, chunk):
        a, b = np.searchsorted(column, [lo, lo + chunk])
        dense = np.zeros((n, min(chunk, wide - lo)), np.float32)
        dense[row[a:b], column[a:b] - lo] = 1
        shared += dense @ dense.T
    return ok & (100 * shared >= percent * (size[:, None] + size[None, :] - shared))


UNIT = ["g1", "s1", "g2", "s2", "i", "j"]


def opened(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links of the documents of each unit, as a spanning forest. members: (doc_id, side) and UNIT; two cells or blocks meet across sides."""

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "data": [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in pdf["text"]]})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for unit in grouped(batches, UNIT):
            tokens, starts = shingle_sets([zlib.decompress(d) for d in unit["data"]], size)
            ids, cross = unit["doc_id"].to_numpy(), any(unit[a].iat[0] != unit[b].iat[0] for a, b in (("g1", "g2"), ("s1", "s2"), ("i", "j")))
            near = similar([tokens[a:b] for a, b in zip(starts[:-1], starts[1:])], unit["side"].to_numpy() if cross else None, percent)
            out += [(int(ids[a]), int(ids[b])) for a, b in forest(near)]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["u", "v"])
                out = []
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    members = cut(members)
    texts = _texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = members.select("doc_id").distinct()
    if members.count() <= LOOKUP:  # only the texts of members are moved then, and not found out after they were
        texts = texts.join(F.broadcast(ids), "doc_id")
    texts = map_small(texts, squeeze, "doc_id long, data binary")
    return texts.join(members, "doc_id").repartition(*UNIT).sortWithinPartitions(*UNIT, "doc_id").mapInPandas(trimmed(verify), "u long, v long")


def stars(docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(u, v): links of the members of groups over BLOCK with a few members of their own group, and of those few across groups; None without such groups.

    They connect a family of near copies already: each member is sent once, whatever the family's size.
    """
    few = F.array_distinct(F.array(*[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))) for k in range(PIVOTS)]))
    large = cut(reps.groupBy("grp").agg(F.count("*").alias("m"), few.alias("pivots")).where(F.col("m") > BLOCK))
    if large.isEmpty():
        return None
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    unit = lambda i, side: [F.lit(0).cast("long").alias("s1"), F.lit(1).cast("long").alias("s2"), i.alias("i"), F.lit(-1).alias("j"), F.lit(side).alias("side")]
    own = [F.col("grp").alias("g1"), F.col("grp").alias("g2")]
    members = reps.join(large, "grp").select("doc_id", *own, *unit(F.pmod(F.xxhash64("doc_id"), blocks).cast("int"), 0))
    pivots = large.select("pivots", *own, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b")).select(F.explode("pivots").alias("doc_id"), "g1", "g2", *unit(F.col("b"), 1))
    one, two = large.select(F.col("grp").alias("g1"), F.col("pivots").alias("p1")), large.select(F.col("grp").alias("g2"), F.col("pivots").alias("p2"))
    both = cut(pairs.join(one, "g1").join(two, "g2"))
    across = [both.select(F.explode(p).alias("doc_id"), "g1", "g2", *unit(F.lit(-1), side)) for side, p in enumerate(("p1", "p2"))]
    return opened(docs, members.unionByName(pivots).unionByName(across[0]).unionByName(across[1]), size, percent)


def edges(docs: DataFrame, info: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links that connect whatever is linked, between the smallest documents of distinct sets.

    A group is cut into cells: what stars() has connected already, each on its own, and the rest. Cells of a group and of two
    qualifying groups meet, block by block, but for members of one connected cell, whose links could add nothing.
    """
    reps = cut(info.where("grp IS NOT NULL AND doc_id IS NOT NULL").groupBy("grp", "a", "b", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "grp"))
    pairs = cut(pairs)
    first = stars(docs, reps, pairs, size, percent)
    rest = F.lit(0).cast("long")
    if first is None:
        cells = reps.withColumn("sub", rest)
    else:
        first = cut(first)
        ends = components(first).select(F.col("id").alias("doc_id"), F.xxhash64("component").alias("sub"))
        cells = cut(reps.join(ends, "doc_id", "left").withColumn("sub", F.coalesce("sub", rest)))
    sizes = cells.groupBy("grp", "sub").agg(F.count("*").alias("m"))
    c1, c2 = (sizes.select(F.col("grp").alias(f"g{k}"), F.col("sub").alias(f"s{k}"), F.ceil(F.col("m") / BLOCK).cast("int").alias(f"b{k}"), F.col("m").alias(f"m{k}")) for k in (1, 2))
    whole = ["g1", "s1", "g2", "s2", "b1", "b2"]
    own = c1.join(c2, F.col("g1") == F.col("g2")).where("s1 < s2 OR s1 = 0 AND s2 = 0 AND m1 > 1").select(*whole)
    todo = cut(own.unionByName(pairs.join(c1, "g1").join(c2, "g2").where("s1 <> s2 OR s1 = 0").select(*whole)))
    same = (F.col("g1") == F.col("g2")) & (F.col("s1") == F.col("s2"))
    sides = todo.select("g1", "s1", "g2", "s2", F.col("g1").alias("grp"), F.col("s1").alias("sub"), F.col("b1").alias("mine"), F.col("b2").alias("others"), F.lit(0).alias("side"))
    sides = sides.unionByName(todo.where(~same).select("g1", "s1", "g2", "s2", F.col("g2").alias("grp"), F.col("s2").alias("sub"), F.col("b2").alias("mine"), F.col("b1").alias("others"), F.lit(1).alias("side")))
    members = cells.join(sides, ["grp", "sub"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("mine")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    i = F.when(same, F.least("block", "other")).when(F.col("side") == 0, F.col("block")).otherwise(F.col("other"))
    j = F.when(same, F.greatest("block", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("block"))
    members = members.select("doc_id", "g1", "s1", "g2", "s2", i.alias("i"), j.alias("j"), F.when(same, F.col("block")).otherwise(F.col("side")).alias("side"))
    found = opened(docs, members, size, percent)
    return found if first is None else found.unionByName(first)


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than `size` words is one shingle; null or
    empty texts have none and link with nothing. Rows with one doc_id are one document for links; each gives a row. A null doc_id links with
    nothing and has a null component. An empty table gives no rows.
    """
    hot = hot_tokens(docs, size)
    info, pairs = matrix(docs, size, percent, hot)
    found = components(edges(docs, info, pairs, size, percent)).withColumnRenamed("id", "rep")
    key = ["grp", "a", "b", "n"]
    least = info.where("grp IS NOT NULL AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep")).join(found, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    least = cut(least)  # a row a distinct set; apart from it, adaptive execution can split the join of a set's many copies
    rows = info.where("grp IS NOT NULL AND doc_id IS NOT NULL").join(least, key).select("doc_id", "n", "component")
    alone = info.where("grp IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"))
    return rows.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns kept, whose document is the smallest of its component (a null doc_id stays)."""
    kept = join(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # so that no column's name can clash
    out = rows.join(kept, F.col("row.doc_id").cast("long") == F.col("kept"), "left").where("kept IS NOT NULL OR row.doc_id IS NULL")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

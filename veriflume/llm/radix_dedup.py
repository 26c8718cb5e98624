"""Exact removal of repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are ordered only through `window` bytes, in three digit passes that drop groups as soon as they cannot
repeat across documents:

1. digit one is the suffix's lowest-hash k-gram (its anchor). All window positions share few anchors, so what is
   exchanged is one small record per run of positions with one anchor, packed as binary columns by anchor bucket;
2. digit two is the whole run of bytes those positions cover. Equal runs are equal windows: every document but the
   smallest loses them. Runs of one document only, whose anchor occurs in no smaller document, cannot repeat;
3. runs that share an anchor but not all bytes (the edges of copied passages) are expanded to their single windows,
   which are grouped by hash: equal groups are exactly the repeated windows.

Map tasks resolve repeats among their own rows first, so a hot passage sends a row per task, not per document. Digits are
sent as 64-bit hashes, two for each group, in place of their bytes, which would be several times the input: windows count as
equal when 128 bits are. A reducer works through its buckets one at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_small, Rolling, shuffle_parts, trimmed

WINDOW = 50
ANCHOR = 24
#: bytes handled at once in numpy; records sent at once; bytes of each hash that are sent; buckets of a reducer, held one at a time
SEGMENT, FLUSH, WIDTH, SHARE = 1 << 20, 300_000, 8, 4
RECORD = np.dtype([("anchor", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("n", "<i4")])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of values[i:i+width], for every i."""
    n = len(values) - width + 1
    best, at, span = values.copy(), np.arange(len(values), dtype=np.int64), 1
    while span < width:
        step = min(span, width - span)
        other = best[step:]
        take = other < best[:-step]
        at[:-step] = np.where(take, at[step:], at[:-step])
        best[:-step] = np.minimum(best[:-step], other)
        best, at = best[:-step], at[:-step]
        span += step
    return at[:n]


def runs_of(buf: np.ndarray, limits: np.ndarray, window: int, k: int):
    """Runs of window starts with one anchor: (first start, count, anchor hash, run hash), never across limits."""
    if len(buf) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    roll = Rolling(buf)
    at = np.arange(len(buf) - k + 1)
    grams = roll.of(at, at + k)
    low = sliding_argmin(grams, window - k + 1)
    starts = np.arange(len(low))
    whole = np.searchsorted(limits, starts, "right") == np.searchsorted(limits, starts + window - 1, "right")
    starts, low = starts[whole], low[whole]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    head = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1)])
    count = np.diff(np.r_[head, len(starts)])
    first = starts[head]
    return first, count, grams[low[head]], roll.of(first, first + count + window - 1)


def _segments(docs: Iterable[tuple[int, bytes]], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, document limits, doc ids, offsets in the document) of at most about SEGMENT bytes; long texts overlap by window-1."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for doc, data in docs:
        for off in range(0, max(1, len(data) - window + 1), SEGMENT):
            piece = data[off : off + SEGMENT + window - 1]
            if len(piece) >= window:
                parts.append((doc, off, piece))
                size += len(piece)
            if size >= SEGMENT:
                yield _pack(parts)
                parts, size = [], 0
    if parts:
        yield _pack(parts)


def _pack(parts):
    buf = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    limits = np.cumsum([len(p) for _, _, p in parts])
    return buf, limits, np.array([d for d, _, _ in parts], np.int64), np.array([o for _, o, _ in parts], np.int64)


def _encode(texts) -> Iterator[bytes]:
    return (t.encode("utf-8", "surrogatepass") if t else b"" for t in texts)


def _settle(rec: np.ndarray):
    """Sorts records by (anchor, run, doc) and says which repeat an earlier document's run."""
    rec = rec[np.lexsort((rec["at"], rec["doc"], rec["run"], rec["anchor"]))]
    new = np.r_[True, (rec["anchor"][1:] != rec["anchor"][:-1]) | (rec["run"][1:] != rec["run"][:-1])] if len(rec) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    least = rec["doc"][new]
    return rec, new, group, rec["doc"] > least[group] if len(rec) else np.zeros(0, bool)


def _narrow(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of 64-bit values."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _widen(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.reshape(-1).view(np.uint64)


def dump(rec: np.ndarray) -> bytes:
    """Records in (doc, at) order as one binary: hashes cut to WIDTH bytes each, places as compressed differences."""
    rec = rec[np.lexsort((rec["at"], rec["doc"]))]
    doc = np.diff(rec["doc"], prepend=np.int64(0))
    at = np.diff(rec["at"], prepend=np.int32(0))
    places = zlib.compress(doc.tobytes() + at.tobytes() + rec["n"].tobytes(), 1)
    return len(rec).to_bytes(4, "little") + _narrow(rec["anchor"], WIDTH) + _narrow(rec["run"], WIDTH) + places


def load(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    rec = np.empty(n, RECORD)
    first, second = 4 + WIDTH * n, 4 + 2 * WIDTH * n
    rec["anchor"], rec["run"] = _widen(data[4:first], WIDTH), _widen(data[first:second], WIDTH)
    places = zlib.decompress(data[second:])
    rec["doc"] = np.cumsum(np.frombuffer(places, np.int64, n))
    rec["at"] = np.cumsum(np.frombuffer(places, np.int32, n, 8 * n))
    rec["n"] = np.frombuffer(places, np.int32, n, 12 * n)
    return rec


def merged(rec: np.ndarray) -> pd.DataFrame:
    """Touching runs of a document as one."""
    rec = rec[np.lexsort((rec["at"], rec["doc"]))]
    head = np.flatnonzero(np.r_[True, (rec["doc"][1:] != rec["doc"][:-1]) | (rec["at"][1:] != rec["at"][:-1] + rec["n"][:-1])])
    return pd.DataFrame({"doc_id": rec["doc"][head], "at": rec["at"][head], "n": np.add.reduceat(rec["n"], head)})


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, data): texts as compressed UTF-8, so that joins by doc_id move less."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "data": [zlib.compress(t, 1) for t in _encode(pdf["text"])]})

    return map_small(docs, run, "doc_id long, data binary").where("doc_id IS NOT NULL")


PARCEL = "bucket int, part int, data binary"


def parcels(held: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """Records of a task for the exchange: one binary a bucket, and (bucket -1) those that repeat the task's own smaller documents."""
    rec, _, _, later = _settle(np.concatenate(held))
    gone, rec = rec[later], rec[~later]
    bucket = (rec["anchor"] >> np.uint64(24)) % np.uint64(buckets * SHARE)
    order = np.argsort(bucket, kind="stable")
    rec, bucket = rec[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rec) else np.zeros(0, np.int64)
    some = [(int(bucket[i]), int(bucket[i]) // SHARE, dump(rec[i:j])) for i, j in zip(starts, np.r_[starts[1:], len(rec)])]
    for part in np.array_split(gone, 1 + len(gone) // 100_000) if len(gone) else ():
        some.append((-1, int(part["run"][0] % np.uint64(buckets)), dump(part)))
    return pd.DataFrame(some, columns=["bucket", "part", "data"])


def settled(found: DataFrame, buckets: int, opens: bool) -> DataFrame:
    """(doc_id, at, n, open) of parcels, brought together by bucket.

    Not open: runs that a smaller document has. Open, if asked for: the smallest document's runs whose anchor other documents
    have with other runs; each distinct run is there once (or as often as that document has it).
    """

    def judged(parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        rec, new, _, later = _settle(np.concatenate(parts))
        if later.any():
            yield merged(rec[later]).assign(open=False)
        if opens and len(rec):
            turn = np.r_[True, rec["anchor"][1:] != rec["anchor"][:-1]]
            starts, which = np.flatnonzero(turn), np.cumsum(turn) - 1
            low, high = np.minimum.reduceat(rec["doc"], starts)[which], np.maximum.reduceat(rec["doc"], starts)[which]
            open_ = ~later & (low != high) & (np.add.reduceat(new.astype(np.int64), starts)[which] > 1)
            if open_.any():
                yield merged(rec[open_]).assign(open=True)

    def reducer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], -1
        for pdf in batches:
            for b, d in zip(pdf["bucket"], pdf["data"]):
                if b < 0:
                    yield merged(load(d)).assign(open=False)
                    continue
                if b != now and held:
                    yield from judged(held)
                    held = []
                now = b
                held.append(load(d))
        if held:
            yield from judged(held)

    return found.repartition(buckets, "part").select("bucket", "data").sortWithinPartitions("bucket").mapInPandas(trimmed(reducer), "doc_id long, at int, n int, open boolean")


def spans(docs: DataFrame, texts: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, at, n): window starts at..at+n-1 of doc_id also start in a smaller doc_id. docs: (doc_id long, text); texts: packed()."""
    buckets = shuffle_parts(docs.sparkSession)

    def mapper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for buf, limits, ids, offs in _segments(zip(pdf["doc_id"], _encode(pdf["text"])), window):
                first, count, anchor, run = runs_of(buf, limits, window, k)
                which = np.searchsorted(limits, first, "right")
                rec = np.empty(len(first), RECORD)
                rec["anchor"], rec["run"], rec["doc"], rec["n"] = anchor, run, ids[which], count
                rec["at"] = first - np.r_[0, limits[:-1]][which] + offs[which]
                held.append(rec)
                size += len(rec)
                if size > FLUSH:
                    yield parcels(held, buckets)
                    held, size = [], 0
        if size:
            yield parcels(held, buckets)

    runs = cut(settled(map_small(docs, mapper, PARCEL), buckets, True))
    opened = runs.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for doc, data, runs_ in zip(pdf["doc_id"], pdf["data"], pdf["runs"]):
                buf = np.frombuffer(zlib.decompress(data), np.uint8)
                at = np.unique(np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in runs_]))
                at = at[at + window <= len(buf)]
                for part in np.unique(at // SEGMENT):
                    some = at[at // SEGMENT == part]
                    base = int(some[0])
                    view = buf[base : int(some[-1]) + window]
                    rec = np.empty(len(some), RECORD)
                    rec["anchor"], rec["run"] = (Rolling(view, salt).of(some - base, some - base + window) for salt in (0, 7))
                    rec["doc"], rec["at"], rec["n"] = doc, some, 1
                    held.append(rec)
                    size += len(rec)
                    if size > FLUSH:
                        yield parcels(held, buckets)
                        held, size = [], 0
        if size:
            yield parcels(held, buckets)

    singles = settled(map_small(texts.join(opened, "doc_id"), expand, PARCEL), buckets, False)
    return runs.where("NOT open").select("doc_id", "at", "n").unionByName(singles.select("doc_id", "at", "n"))


def removed(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; kept is the remaining bytes.

    A byte goes when a window-byte string that covers it also starts in a document with a smaller doc_id. Null text is
    empty. doc_id identifies a document: each of several rows with one doc_id loses what any of them shares with a smaller
    doc_id, and none repeats another; a null doc_id takes no part and loses nothing. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = packed(base)
    marks = spans(base.where("doc_id IS NOT NULL"), texts, window, k).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, runs in zip(pdf["doc_id"], pdf["data"], pdf["runs"]):
                data = zlib.decompress(text)
                kept, n_gone, n_spans = data, 0, 0
                if runs is not None and len(runs):
                    at = np.array([r["at"] for r in runs], np.int64)
                    at = np.minimum(at, len(data))
                    stop = np.minimum(at + np.array([r["n"] for r in runs], np.int64) + window - 1, len(data))
                    depth = np.zeros(len(data) + 1, np.int32)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, stop, -1)
                    dead = np.cumsum(depth[:-1]) > 0
                    n_gone, n_spans = int(dead.sum()), int((np.diff(np.r_[0, dead.astype(np.int8)]) == 1).sum())
                    kept = np.frombuffer(data, np.uint8)[~dead].tobytes()
                rows.append((doc, len(data), n_gone, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    nameless = base.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return map_small(texts.join(marks, "doc_id", "left"), finish, out).unionByName(nameless)

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items. A shift table over blocks of adjacent words says how far a
search position can move without missing a window; only blocks that end some window (shift 0) open a
suffix-hash bucket, whose windows are then compared word by word. Words are numbered, the shift table is an array of bytes by a hash of the
block (blocks that share a place have the least of their shifts), windows are a sorted array of hashes: an automaton takes some
30 bytes a benchmark word and the vocabulary, and stays in a worker from task to task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROOT, cut, keep_rows, map_small, mix, turn_to

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: of the first word's number in a block's hash
SPREAD = 1_000_003
#: benchmark words (of about eight bytes) in one automaton, which is what is broadcast at once; larger benchmarks are searched part
#: by part, one automaton and one pass over the documents each, with the same result
PASS_WORDS = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, as UTF-8 bytes."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WuManber:
    """Windows of one length: shift table, suffix-hash buckets and direct comparison, as sorted arrays."""

    def __init__(self, length: int, items: list[tuple[int, list[int]]], block: int = 2):
        """items: (item number, its words' numbers), `length` words at least each."""
        self.length, self.block = m, b = length, min(block, length)
        self.words = np.concatenate([np.array(w, np.int32) for _, w in items])
        size = np.array([len(w) for _, w in items])
        first = np.r_[0, np.cumsum(size)[:-1]]
        place = np.arange(len(self.words)) - np.repeat(first, size)  # of each word in its item
        ends = np.flatnonzero(place >= b - 1)
        self.mask = (1 << max(10, int(4 * len(ends)).bit_length())) - 1
        where = self.words[ends].astype(np.int64) if b == 1 else self.words[ends - 1].astype(np.int64) * SPREAD + self.words[ends]
        table = np.full(self.mask + 1, m - b + 1)
        np.minimum.at(table, where & self.mask, np.maximum(0, m - 1 - place[ends]))  # a block that ends early in its item can only end a window later
        self.shift = np.minimum(table, 255).astype(np.uint8).tobytes()
        self.starts = np.flatnonzero(place <= np.repeat(size, size) - m).astype(np.int32)
        hashed = self._windows(self.words[self.starts[:, None] + np.arange(m)])
        order = np.argsort(hashed, kind="stable")
        self.starts, self.hashed = self.starts[order], hashed[order]
        self.item = np.repeat(np.array([i for i, _ in items], np.int32), size)[self.starts]

    @staticmethod
    def _windows(windows: np.ndarray) -> np.ndarray:
        """A hash of each row of word numbers."""
        code = mix(windows.astype(np.uint64) + np.uint64(1))
        out = np.zeros(len(windows), np.uint64)
        for i in range(windows.shape[1]):
            out = mix(out * ROOT + code[:, i])
        return out

    def search(self, words: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, item numbers) of every occurrence; number: what the items' words are numbered."""
        m, b, shift, mask, get = self.length, self.block, self.shift, self.mask, number.get
        where, at, last, far = [], m - b, len(words) - b, m - b + 1  # at: where a window's last block begins
        while at <= last:
            x = get(words[at])
            if x is None:  # no window holds this word
                at += far
                continue
            if b > 1:
                y = get(words[at + 1])
                if y is None:
                    at += far + 1
                    continue
                x = x * SPREAD + y
            step = shift[x & mask]
            if step:
                at += step
                continue
            where.append(at + b - m)
            at += 1
        if not where:
            return
        texts = np.array([[get(w, -1) for w in words[s : s + m]] for s in where], np.int32)
        hashed = self._windows(texts)
        low, high = np.searchsorted(self.hashed, hashed, "left"), np.searchsorted(self.hashed, hashed, "right")
        for k in np.flatnonzero(high > low):
            bucket = slice(low[k], high[k])
            same = (self.words[self.starts[bucket, None] + np.arange(m)] == texts[k]).all(1)
            if same.any():
                yield where[k], self.item[bucket][same]


class Automaton:
    """All windows of a list of items, and what its words are numbered."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.items: list = []
        by: dict[int, list[tuple[int, list[int]]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            if size:
                by.setdefault(size, []).append((len(self.items), [self.number.setdefault(w, len(self.number)) for w in words]))
                self.items.append(item)
        self.machines = [WuManber(size, some) for size, some in by.items()]

    def find(self, words: list[bytes]) -> tuple[bytearray, set]:
        """A flag per word (inside an occurrence), and the items with occurring windows."""
        hit, found = bytearray(len(words)), set()
        for machine in self.machines:
            ones = b"\x01" * machine.length
            for at, whose in machine.search(words, self.number):
                hit[at : at + machine.length] = ones
                found.update(whose.tolist())
        return hit, {self.items[i] for i in found}

    def any(self, words: list[bytes]) -> bool:
        return any(True for m in self.machines for _ in m.search(words, self.number))


_KEPT: dict[str, Automaton] = {}


def automaton(name: str, items: Iterable[tuple[object, str | None]], window: int) -> Automaton:
    """The automaton of a broadcast of that name: a worker builds it once, and keeps the last one."""
    turn_to("decontaminate", _KEPT.clear)
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Automaton(items, window)
    return _KEPT[name]


def parts_of(benchmark: DataFrame, limit: int = PASS_WORDS) -> Iterator[list[tuple]]:
    """The items in lists of about 8 * limit bytes at most, one at a time: neither the driver nor a task ever holds more than one."""
    b = benchmark.where("text IS NOT NULL").select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (limit * 8)))
    if n == 1:
        yield [tuple(r) for r in b.collect()]
        return
    b = cut(b.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))))  # the text too: null ids spread as well
    for k in range(n):
        yield [tuple(r) for r in b.where(F.col("part") == k).drop("part").collect()]


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = PASS_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    Null text has no words; an item without words has no window; items that share an item_id count as one. Items
    with a null item_id are searched like all others; together they count as one in n_items, and items_sha256 leaves them
    out. Repeated documents each give a row. A document word inside any occurrence is hit. Texts are searched whole, one at a
    time. An empty benchmark hits nothing, empty documents give no rows. A benchmark of more than `limit` words is searched part
    by part (see PASS_WORDS): each part's hits are written as (text, spans, items) and summed up by text in the end.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    every = list(_two(parts_of(benchmark, limit)))
    if len(every) == 1:
        shared = spark.sparkContext.broadcast(every[0])

        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = automaton(name, shared.value, window)
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    words = words_of(text)
                    hit, items = machine.find(words)
                    n = sum(hit)
                    rows.append((doc, len(words), n, len(items), _digest({str(i) for i in items if i is not None}), n > 0))
                yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return map_small(base, run, f"doc_id {kind}, {OUT}")

    keyed = base.select("*", F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b"))
    hits = []
    for items in parts_of(benchmark, limit):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pd.DataFrame], shared=shared, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            machine = automaton(name, shared.value, window)
            for pdf in batches:
                rows = []
                for a, b, text in zip(pdf["a"], pdf["b"], pdf["text"]):
                    hit, found = machine.find(words_of(text))
                    if found:
                        flags = re.finditer(rb"\x01+", bytes(hit))
                        rows.append((a, b, [x for m in flags for x in m.span()], [None if i is None else str(i) for i in found]))
                yield pd.DataFrame(rows, columns=["a", "b", "spans", "items"])

        hits.append(cut(map_small(keyed.select("a", "b", "text"), search, "a long, b long, spans array<int>, items array<string>")))
        shared.destroy()
    met = reduce(DataFrame.unionByName, hits).distinct().groupBy("a", "b").agg(F.collect_list("spans").alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "a": pdf["a"], "b": pdf["b"], "n_words": [len(words_of(t)) for t in pdf["text"]]})

    rows = map_small(keyed, count, f"doc_id {kind}, a long, b long, n_words long").join(met, ["a", "b"], "left").select("doc_id", "n_words", "spans", "items")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, n_words, spans, items in zip(pdf["doc_id"], pdf["n_words"], pdf["spans"], pdf["items"]):
                n, end, who = 0, 0, set() if items is None else set(items)
                pairs = sorted((s[i], s[i + 1]) for s in ([] if spans is None else spans) for i in range(0, len(s), 2))
                for lo, hi in pairs:
                    n += max(0, hi - max(lo, end))
                    end = max(end, hi)
                out.append((doc, n_words, n, len(who), _digest({i for i in who if i is not None}), n > 0))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return map_small(rows, finish, f"doc_id {kind}, {OUT}")


def _two(parts: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """The first list, and whether there is another one, as an empty list."""
    yield next(parts)
    if next(parts, None) is not None:
        yield []


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = PASS_WORDS) -> DataFrame:
    """The rows of docs, all columns kept, in which no benchmark window occurs (null texts stay).

    A benchmark of more than `limit` words takes a pass over what is left for each of its parts, written in between.
    """
    spark = docs.sparkSession

    def without(rows: DataFrame, items: list[tuple]) -> tuple[DataFrame, object]:
        shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def start() -> Callable[[str | None], bool]:
            machine = automaton(name, shared.value, window)
            return lambda text: not machine.any(words_of(text))

        return keep_rows(rows, "text", start), shared

    parts = parts_of(benchmark, limit)
    kept, shared = without(docs, next(parts))
    for items in parts:
        kept = cut(kept)
        shared.destroy()
        kept, shared = without(kept, items)
    return kept

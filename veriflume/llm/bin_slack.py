"""Best-fit packing of tokenised documents by minimum bin slack.

The driver sees only a histogram of piece lengths (at most `capacity` entries, whatever the corpus). For each bin,
a bitset subset-sum DP over the lengths still available finds the fullest combination that holds the largest of
them; it is removed as often as the counts allow at once. The resulting plan says, for the r-th piece of a length,
its sequence and offset; executors look that up.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_small, Rolling, trimmed, turn_to

CAPACITY = 2048
#: pieces of one length are ranked in parts of about so many, or of more where that would make over MOST_PARTS parts
PART, MOST_PARTS = 1024, 100_000
#: bytes that a worker remembers of chunks of text, their ids and the bookkeeping of both; bytes of text split at once
CACHE, STRIDE = 160_000_000, 1_000_000
#: texts on which a tokenizer must agree with the split into chunks, else it gets whole texts
PROBES = [
    "Plain words, and MORE of them.", "don't I'M we'll o'clock 'tis", "a.b,c;d e--f ... g?! (h) [i] {j}", "x_y 12,5 3.14 100% #tag @me", "Ünïcödé straße ΣΑΣ İstanbul ŉ ﬁ Ǆ", "tabs\tand\nlines\r\nand\x0bmore  spaces ",
    "日本語 テスト。 word", "a\x1cb \x1f c", "e\u0301 \u0301e é\u0301", "word### tail&&& it's,' \"quoted\"", " lead and trail ", "don' t , ' s",
]


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """[(length, uses)] of a combination of the available (length, count) that fills room best; longest first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size, count in lengths:
        if size > room:
            continue
        before, left, part = reach, min(count, room // size), 1
        most = left
        while left:
            part = min(part, left)
            reach |= (reach << (part * size)) & mask
            left -= part
            part *= 2
        steps.append((size, most, before))
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, []
    for size, most, before in reversed(steps):
        n = next(n for n in range(most + 1) if at >= n * size and before >> (at - n * size) & 1)
        if n:
            used.append((size, n))
            at -= n * size
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, pieces a sequence, offset) that place every piece."""
    left = {k: v for k, v in histogram.items() if v}
    taken = dict.fromkeys(left, 0)
    slots, base = [], 0
    while left:
        top = max(left)
        rest = sorted(((k, v - (k == top)) for k, v in left.items() if v > (k == top)), reverse=True)
        uses = dict(fullest(rest, capacity - top))
        uses[top] = uses.get(top, 0) + 1
        times = min(left[k] // u for k, u in uses.items())
        offset = 0
        for k in sorted(uses, reverse=True):
            u = uses[k]
            slots.append((k, taken[k], taken[k] + times * u, base, u, offset))
            offset += u * k
            taken[k] += times * u
            left[k] -= times * u
            if not left[k]:
                del left[k]
        base += times
    return slots


#: a Latin word and ASCII punctuation after it (no apostrophe, which may start a contraction)
LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SMALL = (np.arange(256) >= 97) & (np.arange(256) < 123)
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) < 91), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
PUNCTUATION = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))


def chunks_of(low: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of runs without ASCII white space; with split, ASCII punctuation that ends one after a-z is a run of its own."""
    n = len(low)
    space = SPACE[low]
    if split:
        mark = PUNCTUATION[low]
        after = np.minimum.accumulate(np.where(mark, n, np.arange(n))[::-1])[::-1]  # the next byte that is no punctuation
        ends = np.r_[space, True][after] & mark
        ends[1:] &= SMALL[low[:-1]]
        ends[:1] = False
    else:
        ends = np.zeros(n, bool)
    start = np.flatnonzero(~space & (np.r_[True, space[:-1]] | ends))
    stop = np.flatnonzero(~space & (np.r_[space[1:], True] | np.r_[ends[1:], False])) + 1
    return start, stop


class Encoder:
    """Token ids of texts, one chunk between ASCII white space at a time.

    Right only for tokenizers whose splitting never joins across white space, to which punctuation after a word is a token
    sequence of its own, and which lower-case and mark word ends: Latin words are encoded in lower case, many to a call, and
    told apart by the word-end mark of their last tokens. All other chunks are encoded one by one as they are. Texts near the
    start of a special token are neither lower-cased nor split at punctuation beforehand. Texts are taken many at once: chunks
    are found, told apart (by 64-bit hashes within STRIDE bytes) and expanded to ids in numpy; only distinct chunks are looked
    up, by their bytes. A tokenizer without these properties (its file says so, or PROBES do) gets whole texts instead.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = json.dumps([made.get("normalizer"), made.get("pre_tokenizer")])
        suffix = made["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.whole = not suffix or '"Lowercase"' not in steps or '"add_prefix_space": true' in steps
        self._forget()
        if not self.whole:
            try:
                self.whole = list(self.encode(PROBES)) != self._each(PROBES)
            except (KeyError, IndexError, ValueError):
                self.whole = True
            self._forget()

    def _forget(self) -> None:
        self.tails: dict[str, bytes] = {}
        self.known: dict[bytes, int] = {}
        self.held = self.count = self.filled = 0
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, "<u4")

    def _each(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(chunks), 5000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks[at : at + 5000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Lower-case Latin words."""
        out: list[bytes] = []
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                out += self._each(some)
                continue
            data, stop = ids.tobytes(), (cuts * 4).tolist()
            out += [data[i:j] for i, j in zip([0, *stop], stop)]
        return out

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        tails = self.tails
        parts = [(m[1].lower(), m[2]) if (m := LATIN(w)) else None for w in chunks]
        low = list({p[0] for p in parts if p})
        words = dict(zip(low, self._words(low)))
        marks = list({p[1] for p in parts if p} - tails.keys())
        tails.update(zip(marks, self._each(marks)))
        self.held += sum(map(len, marks)) + 260 * len(marks)
        others = iter(self._each([w for w, p in zip(chunks, parts) if not p]))
        return [words[p[0]] + tails[p[1]] if p else next(others) for p in parts]

    def _learn(self, chunks: list[bytes]) -> None:
        found = self._fresh([c.decode() for c in chunks])
        sizes = np.array([len(x) // 4 for x in found], np.int32)
        total, n = int(sizes.sum()), len(found)
        for name, need in (("start", self.count + n), ("size", self.count + n), ("ids", self.filled + total)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)]))
        self.start[self.count : self.count + n] = self.filled + np.r_[0, np.cumsum(sizes)[:-1]]
        self.size[self.count : self.count + n] = sizes
        self.ids[self.filled : self.filled + total] = np.frombuffer(b"".join(found), "<u4")
        self.known.update(zip(chunks, range(self.count, self.count + n)))
        self.held += sum(map(len, chunks)) + 180 * n + 8 * total
        self.count, self.filled = self.count + n, self.filled + total

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of every text in turn, as little-endian bytes; texts are taken together up to about STRIDE bytes."""
        held, size = [], 0
        for t in texts:
            held.append(t.encode() if t else b"")
            size += len(held[-1])
            if size > STRIDE:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if self.whole:
            return self._each([t.decode("utf-8", "surrogatepass") for t in texts])
        if self.held > CACHE:
            self._forget()
        data = b"\n".join(texts)
        plain = b"<|" not in data  # else a special token could be made or broken
        low = np.frombuffer(data, np.uint8)
        if plain:
            low = LOWER[low]
            data = low.tobytes()
        start, stop = chunks_of(low, plain)
        if not len(start):
            return [b""] * len(texts)
        _, first, chunk = np.unique(Rolling(low).of(start, stop), return_index=True, return_inverse=True)
        keys = [data[i:j] for i, j in zip(start[first].tolist(), stop[first].tolist())]
        row = list(map(self.known.get, keys))
        new = [k for k, r in zip(keys, row) if r is None]
        if new:
            self._learn(new)
            row = [self.known[k] if r is None else r for k, r in zip(keys, row)]
        at = np.array(row)[chunk]
        size, begin = self.size[at].astype(np.int64), self.start[at]
        past = np.cumsum(size)
        ids = self.ids[np.repeat(begin - past + size, size) + np.arange(past[-1])].tobytes()
        # where each text's chunks end
        edges = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]), "left")
        bytes_at = (np.r_[0, past][np.r_[0, edges]] * 4).tolist()
        return [ids[i:j] for i, j in zip(bytes_at[:-1], bytes_at[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and end_id, cut every `capacity` tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("bin_slack", _ENCODERS.clear)
        encoder, wide = encoder_of(tokenizer), capacity * 4
        for pdf in batches:
            out = []
            for doc, ids in zip(pdf["doc_id"], encoder.encode(pdf["text"])):
                ids += tail
                for k, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_small(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A null or empty text is a document of the end id alone. Repeated rows are documents of their own. An empty table
    gives no rows. The pieces are written once to the shared scratch folder. The driver gets how many pieces a length has, in
    parts of PART pieces or more: `capacity` + MOST_PARTS rows at most, whatever the corpus. No task ranks more than a few parts.
    """
    spark = docs.sparkSession
    cuts = cut(pieces(docs, tokenizer, capacity, end_id))
    per = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    part = max(PART, -(-sum(per.values()) // MOST_PARTS))
    several = spark.createDataFrame([(k, -(-n // part)) for k, n in sorted(per.items()) if n > part], "length long, parts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("parts", F.lit(1))).cast("int")
    cuts = cuts.join(F.broadcast(several), "length", "left").withColumn("salt", salt).drop("parts")  # at most `capacity` rows
    counts = sorted((r["length"], r["salt"], r["n"]) for r in cuts.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    offsets, total = {}, {}
    for size, k, n in counts:
        offsets[size, k] = total.get(size, 0)
        total[size] = offsets[size, k] + n
    by: dict[int, list] = {}
    for slot in plan(total, capacity):
        by.setdefault(slot[0], []).append(slot[1:])
    table = spark.sparkContext.broadcast((offsets, {k: np.array(sorted(v), np.int64) for k, v in by.items()}))
    ranked = cuts.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offset_of, slots_of = table.value
        for pdf in batches:
            sizes = pdf["length"].to_numpy()
            start = np.fromiter((offset_of[k] for k in zip(sizes, pdf["salt"])), np.int64, len(pdf))
            rank, sequence, offset = pdf["rank"].to_numpy() + start, np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for size in np.unique(sizes):
                mine, slots = sizes == size, slots_of[size]
                s = slots[np.searchsorted(slots[:, 0], rank[mine], "right") - 1]
                within = rank[mine] - s[:, 0]
                sequence[mine], offset[mine] = s[:, 2] + within // s[:, 3], s[:, 4] + within % s[:, 3] * size
            yield pdf.drop(columns=["salt", "rank"]).assign(sequence_id=sequence, offset=offset)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank").mapInPandas(trimmed(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

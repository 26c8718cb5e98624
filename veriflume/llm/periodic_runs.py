"""Periodic runs of words inside a document, and texts with such runs collapsed to one period.

A run is a maximal stretch of words with smallest period q and a length of at least max(6, 4 q). In a run of period q every word
lies in a k-gram that comes back q words on, k being the least overlap of a run with itself moved by its period: max(6, 4 q) - q,
which is never under 5. So words outside all repeated 5-grams of their document are masked out, and only the stretches between
them are searched.

Each stretch is searched by divide and conquer as by Main and Lorentz: blocks of doubling width, and for each the runs that cross
its centre. A run of four periods has two of them on one side of the centre, so a square that starts or ends there gives it
away; hashes propose squares for all centres and periods of a level at once, and comparing the words themselves confirms them and
finds how far they reach. A run that its block cuts off is left to the wider block in whose middle it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROOT, map_small, mix, powers, turn_to

#: least length of a run in words and in periods; the mask's k-grams and the first block width follow from both
LEAST, TIMES = 6, 4
OVERLAP = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))
FIRST_BLOCK = 1 << (LEAST - 1).bit_length()
#: squares proposed at once: bounds a task's arrays, whatever the text's length
AT_ONCE = 1 << 20


def surviving(ids: np.ndarray) -> np.ndarray:
    """(start, stop) of the maximal stretches of words that repeated OVERLAP-grams cover. Equal hashes only add words."""
    n = len(ids)
    if n < LEAST:
        return np.empty((0, 2), np.int64)
    code = mix(ids.astype(np.uint64) + np.uint64(1))
    gram = code[: n - OVERLAP + 1].copy()
    for i in range(1, OVERLAP):
        gram = mix(gram * ROOT + code[i : n - OVERLAP + 1 + i])
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    repeated = np.zeros(len(gram), bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(repeated)
    if not len(at):
        return np.empty((0, 2), np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + OVERLAP, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix of two equally long arrays, compared in doubling pieces."""
    at, size, n = 0, 16, len(a)
    while at < n:
        differ = a[at : at + size] != b[at : at + size]
        if differ.any():
            return at + int(differ.argmax())
        at += size
        size *= 2
    return n


def _level(s: np.ndarray, sums: np.ndarray, back: np.ndarray, width: int, found: set) -> None:
    """Adds the runs (start, stop, period) of s that cross the centre of a block of this width and lie inside it."""
    n, half = len(s), width // 2
    periods = np.arange(1, max(width // TIMES, 1) + 1)
    centres = np.arange(half, n, width)
    together = max(1, AT_ONCE // len(periods))
    hashed = lambda i, j: (sums[j] - sums[i]) * back[i]  # noqa: E731  of words i..j-1
    for side in (1, -1):
        for at in range(0, len(centres), together):
            c, p = np.repeat(centres[at : at + together], len(periods)), np.tile(periods, len(centres[at : at + together]))
            fits = (c + 2 * p <= n) if side > 0 else (c >= 2 * p)
            c, p = c[fits], p[fits]
            i = c if side > 0 else c - 2 * p
            square = hashed(i, i + p) == hashed(i + p, i + 2 * p)
            c, p = c[square], p[square]
            while len(c):  # the shortest period of every centre; what its run explains goes
                first = np.concatenate([[True], c[1:] != c[:-1]])
                starts = np.flatnonzero(first)
                until = np.zeros(len(starts), np.int64)
                for k, x in enumerate(starts):
                    centre, q = int(c[x]), int(p[x])
                    lo, hi = centre - half, min(centre + half, n)
                    a = centre if side > 0 else centre - q  # words a.. and a+q.. are compared on, those before a and a+q back
                    stop = a + q + _reach(s[a : hi - q], s[a + q : hi])
                    start = a - _reach(s[lo:a][::-1], s[lo + q : a + q][::-1])
                    whole = (start == 0 or s[start - 1] != s[start - 1 + q]) and (stop == n or s[stop] != s[stop - q])
                    if stop - start >= max(LEAST, TIMES * q) and whole:
                        found.add((start, stop, q))
                    if stop - start >= 2 * q:
                        until[k] = stop - centre if side > 0 else centre - start
                left = ~first & (2 * p > np.repeat(until, np.diff(np.concatenate([starts, [len(c)]]))))
                c, p = c[left], p[left]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period."""
    out = []
    for lo, hi in surviving(ids):
        s = ids[lo:hi]
        n = len(s)
        if n < LEAST:
            continue
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(s.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
        back, found, width = powers(n + 1, inverse=True), set(), FIRST_BLOCK
        while True:
            _level(s, sums, back, width, found)
            if width >= n:
                break
            width *= 2
        out += [(int(lo) + a, b - a, q) for a, b, q in found]
    return sorted((a, n, q) for a, n, q in out)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []  # bytes are split at \x20 and \x09-\x0D alone


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, text): runs is an array of (start, length, period) in words, by start, then period; text has every run's
    first period only, its words joined by one space.

    Null, empty and blank texts have no run and an empty text. Every row gives a row, repeated ones and null ids too. Texts are
    searched whole, one at a time; only doc_id and text are read, other columns may have any name.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("periodic runs")
        for pdf in batches:
            runs, texts = [], []
            for text in pdf["text"]:
                words = words_of(text)
                ids = numbered(words)
                found = find_runs(ids)
                if found:
                    keep = np.ones(len(words), bool)
                    for a, n, q in found:
                        keep[a + q : a + n] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "runs": runs, "text": texts})

    return map_small(docs.select("doc_id", F.col("text").cast("string").alias("text")), search, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, text string")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what detect() gives.

    The four middle ones tell of the run with the greatest length a period (compared as fractions; ties: smallest start, then
    period) and are null where there is none.
    """
    def better(best: Column, run: Column) -> Column:  # runs come by start, then period: only a greater fraction wins
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", F.reduce("runs", none, better))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; where h = crc32(doc_id as text) is divisible by 10, the words from a on repeat with period p: with
    n words and g = h div 10, a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Texts of null ids stay as they are."""
    words = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = words.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))))
    words = words.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    words = words.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("CASE WHEN h % 10 = 0 AND n > 0 THEN concat_ws(' ', transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)]))) ELSE text END")
    return words.select("doc_id", text.alias("text"))

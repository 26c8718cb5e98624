"""URL filtering with a bit-parallel wildcard automaton.

All rules are compiled to globs over one canonical string per URL and packed side by side into multiword
Shift-And masks: one bit per glob position, one self-loop bit set per '*'. A batch of URLs then advances
through the automaton together, one byte position at a time, each step being a shift, an OR and an AND on
every word of every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rule strings of the production list and their verdicts
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
AFTER_SCHEME = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first '://', A-Z lower-cased; both empty without '://'."""
    found = AFTER_SCHEME.search(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


class Automaton:
    """Shift-And over many globs at once. In a glob, '*' is any run of bytes and '\\x01' any run without '/'."""

    def __init__(self, globs: Sequence[bytes]):
        symbols: list[tuple[int, bool, int]] = []  # byte, first of its glob, loop kind before it
        ends, at_start, self.tail = [], [], []
        for g in globs:
            loop, first, count = 0, True, 0
            for byte in g:
                if byte in (0x2A, 0x01):
                    loop = 2 if byte == 0x2A else max(loop, 1)
                    continue
                symbols.append((byte, first, loop))
                first, loop, count = False, 0, count + 1
            if not count:
                raise ValueError("a glob needs a literal byte")
            ends.append(len(symbols) - 1)
            self.tail.append(loop)
        self.words = max(1, -(-len(symbols) // 64))
        self.ends = ends
        zero = lambda: np.zeros(self.words, np.uint64)
        self.mask = np.zeros((256, self.words), np.uint64)
        self.start, self.first, self.loop_any, self.loop_seg = zero(), zero(), zero(), zero()
        self.start_any, self.start_seg, self.tail_any, self.tail_seg = zero(), zero(), zero(), zero()
        put = lambda a, i: a.__setitem__(i // 64, a[i // 64] | np.uint64(1 << (i % 64)))
        for i, (byte, first, loop) in enumerate(symbols):
            put(self.mask[byte], i)
            if first:
                put(self.first, i)
                put(self.start, i)
                if loop:
                    put(self.start_any if loop == 2 else self.start_seg, i)
            elif loop:  # the state before this symbol waits
                put(self.loop_any if loop == 2 else self.loop_seg, i - 1)
        for e, loop in zip(ends, self.tail):
            if loop:
                put(self.tail_any if loop == 2 else self.tail_seg, e)

    def _up(self, state: np.ndarray) -> np.ndarray:
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out & ~self.first

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean [texts, globs]: does the whole text fit the glob?"""
        out = np.zeros((len(texts), len(self.ends)), bool)
        order = np.argsort([len(t) for t in texts], kind="stable")
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at) * len(texts[order[stop]]) < 4_000_000 and stop - at < 20_000:
                stop += 1
            ids = order[at:stop]
            out[ids] = self._run([texts[i] for i in ids])
            at = stop
        return out

    def _run(self, texts: list[bytes]) -> np.ndarray:
        n, size = len(texts), np.array([len(t) for t in texts])
        wide = int(size.max(initial=0))
        chars = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), np.uint8).reshape(n, wide) if wide else np.zeros((n, 0), np.uint8)
        state = np.zeros((n, self.words), np.uint64)
        waiting = np.broadcast_to(self.start, state.shape).copy()  # globs whose first symbol may come next
        keep_any, keep_seg = self.loop_any | self.tail_any, self.loop_seg | self.tail_seg
        for j in range(wide):
            c = chars[:, j]
            seg = np.where((c == 0x2F)[:, None], np.uint64(0), keep_seg)
            stay = state & (keep_any | seg)
            moved = (self._up(state) | waiting) & self.mask[c] | stay
            wait = waiting & (self.start_any | np.where((c == 0x2F)[:, None], np.uint64(0), self.start_seg))
            live = (j < size)[:, None]
            state, waiting = np.where(live, moved, state), np.where(live, wait, waiting)
        return np.stack([(state[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1) for e in self.ends], 1).astype(bool)


def glob_of(rule: str) -> bytes:
    """A rule 'host/path' as a glob over '.host' + path: any subdomains before, any rest after."""
    host, slash, path = rule.partition("/")
    return b"\x01." + host.translate(UPPER).encode() + (slash + path).encode() + b"*"


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) of every row; the longest fitting rule wins, else the default.

    A null url or one without '://' has an empty host and path and fits no rule. Rules of one length tie by
    'block' before 'allow', then by text. Repeated rows each give a row; a null key stays null. Hosts are taken
    literally (port and user info belong to them). Non-key columns of the input other than url are ignored.
    """
    ranked = sorted(dict.fromkeys(rules), key=lambda r: (-len(r[0]), r[1] != "block", r[0]))
    machine = Automaton([glob_of(r) for r, _ in ranked]) if ranked else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [split_url(u) for u in pdf["url"]]
            best: list[tuple[str | None, str]] = [(None, default)] * len(parts)
            if machine and parts:
                fits = machine.match([b"." + h.encode("utf-8", "surrogatepass") + p.encode("utf-8", "surrogatepass") if h else b"" for h, p in parts])
                hit = fits.any(1)
                best = [ranked[k] if f else (None, default) for f, k in zip(hit, fits.argmax(1))]
            yield pd.DataFrame({key: pdf[key], "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [r for r, _ in best], "verdict": [v for _, v in best]})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col("url").cast("string").alias("url")).mapInPandas(run, f"{key} {kind}, host string, path string, rule string, verdict string")

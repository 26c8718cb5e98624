"""Filter interaction audit: what each filter removes in every order of the filters, per part of the corpus.

Exact duplicates are found over an RDD that is routed by fingerprint: (xxhash of the text, the text and the smallest id that has it).
Map tasks keep a chain of texts a fingerprint, with the full text and the smallest id of each, and send only chains, so that a
text with millions of copies leaves a task once; rows that lose to a smaller id are sent on without their text, under a key of
their own. A reducer sees fingerprints in order and holds the chain of one at a time. Every document ends as a mask of the filters
that it fails; combineByKey merges vectors of counts by mask, and an order's removals are sums over such a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import shuffle_parts, trim

UPPER = bytes(range(ord("A"), ord("Z") + 1))
ODD = b"#$%&*|"
#: bytes of distinct texts that a map task remembers before it sends its chains; bytes of text a reducer is meant to get
CHAINS, SHARE = 32 << 20, 32 << 20

#: failure conditions over (text, its UTF-8 bytes, its words), by letter
Test = Callable[[str, bytes, list[bytes]], bool]
TESTS: dict[str, Test] = {
    "A": lambda text, raw, words: len(words) < 200,
    "B": lambda text, raw, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda text, raw, words: 100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * len(text),
    "D": lambda text, raw, words: len(raw.translate(None, ODD)) < len(raw),
}
#: the filter of exact copies
COPY = "E"


def mask_of(text: str, tests: dict[str, Test]) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at \x20 and \x09-\x0D alone
    return sum(1 << i for i, fails in enumerate(tests.values()) if fails(text, raw, words))


class Chains:
    """Texts by fingerprint: of each the full text, the smallest id and what the rows with that id carry, counted."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.size = 0

    def add(self, fingerprint: int, text: bytes, least, rows: dict) -> Iterator[tuple]:
        """Takes in a text; yields (id, what it carries, count) of the rows that are found not to have the smallest id."""
        chain = self.of.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, least, dict(rows)])
            self.size += len(text) + 200
        elif least == entry[1]:
            for k, n in rows.items():
                entry[2][k] = entry[2].get(k, 0) + n
        else:
            if least < entry[1]:
                entry[1], least, entry[2], rows = least, entry[1], dict(rows), entry[2]
            for k, n in rows.items():
                yield least, k, n

    def drain(self) -> Iterator[tuple]:
        for fingerprint, chain in self.of.items():
            for text, least, rows in chain:
                yield fingerprint, text, least, rows
        self.of, self.size = {}, 0


def masks(docs: DataFrame, part: str = "lang", tests: dict[str, Test] | None = None, chains: int = CHAINS) -> RDD:
    """(doc_id, part, mask, count) of all rows of docs; the bit after those of the tests is that of a copy of a smaller id's text.

    Null texts count as empty, a null part as ''. A row with a null id is no copy of another, nor another one of it. Rows with one
    id do not make each other copies.
    """
    tests = TESTS if tests is None else tests
    copy = 1 << len(tests)

    def local(rows: Iterator) -> Iterator[tuple]:
        held = Chains()
        loser = lambda i, k, n: (xxhash.xxh64_intdigest(str(i)), (None, i, {(k[0], k[1] | copy): n}))  # noqa: E731  spread by id: no key is hot
        for doc, text, value in rows:
            text = text or ""
            carried = {(value or "", mask_of(text, tests)): 1}
            if doc is None:
                yield xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")), (None, None, carried)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            for lost in held.add(xxhash.xxh64_intdigest(raw), raw, doc, carried):
                yield loser(*lost)
            if held.size > chains:
                for fingerprint, *entry in held.drain():
                    yield fingerprint, tuple(entry)
        for fingerprint, *entry in held.drain():
            yield fingerprint, tuple(entry)

    def settle(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, last = Chains(), None
        final = lambda: ((least, *k, n) for _, _, least, carried in held.drain() for k, n in carried.items())
        for fingerprint, (raw, doc, carried) in rows:
            if raw is None:
                for k, n in carried.items():
                    yield (doc, *k, n)
                continue
            if fingerprint != last:
                yield from final()
                last = fingerprint
            for least, k, n in held.add(fingerprint, raw, doc, carried):
                yield (least, k[0], k[1] | copy, n)
        yield from final()
        trim()

    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(shuffle_parts(docs.sparkSession), -(-size // SHARE))  # reducers grow with the input, whatever the setting says
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col(part).cast("string")).rdd.map(tuple)
    return rows.mapPartitions(local).repartitionAndSortWithinPartitions(n, lambda h: h).mapPartitions(settle)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text a smaller id has too."""
    kind = docs.schema["doc_id"].dataType
    bit = 1 << len(TESTS)
    ids = masks(docs.select("doc_id", "text", F.lit("").alias("part")), "part").filter(lambda r: r[2] & bit).map(lambda r: (r[0],))
    return docs.sparkSession.createDataFrame(ids, StructType([StructField("doc_id", kind)])).distinct()


def count_vectors(rows: RDD, n_masks: int) -> RDD:
    """(part, counts) of rows (part, mask, good, toxic, count): a row of counts a mask, of documents, good ones and toxic ones."""

    def add(total: np.ndarray, row: tuple) -> np.ndarray:
        mask, good, toxic, n = row
        total[mask] += (n, n * good, n * toxic)
        return total

    return rows.map(lambda r: (r[0], r[1:])).combineByKey(lambda r: add(np.zeros((n_masks, 3), np.int64), r), add, lambda a, b: a + b)


def effects(counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters."""
    n = len(letters)
    which = np.arange(1 << n)
    total = {}
    rows = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order):
            bit = 1 << f
            here = (which & bit > 0) & (which & before == 0)
            removed, good, toxic = counts[here].sum(0).tolist()
            redundant = int(counts[(which & bit > 0) & (which & before > 0), 0].sum())
            before |= bit
            kept = int(counts[which & before == 0, 0].sum())
            total[f] = total.get(f, 0) + removed
            rows.append(("".join(letters[i] for i in order), step + 1, f, kept, removed, redundant, int(counts[bit, 0]), good, toxic))
    for order, step, f, *values in rows:
        yield (order, step, *values, total[f])


OUT = StructType([StructField("part", StringType()), StructField("filter_order", StringType()), StructField("step", IntegerType())] + [StructField(c, LongType()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", tests: dict[str, Test] | None = None) -> DataFrame:
    """A row for every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Masks and their handling of nulls: see masks(). A document is good (toxic) if any of its labels says so; one without a label is
    neither. Repeated rows count each. No documents give no rows; extra columns of docs are not read.
    """
    spark = docs.sparkSession
    tests = TESTS if tests is None else tests
    letters = "".join(tests) + COPY
    seen = spark.createDataFrame(masks(docs, part, tests), StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("part", StringType()), StructField("mask", LongType()), StructField("n", LongType())]))
    seen = seen.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = seen.join(flags, "doc_id", "left").groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))
    vectors = count_vectors(rows.rdd.map(tuple), 1 << len(letters))
    return spark.createDataFrame(vectors.flatMap(lambda kv: ((kv[0], *r) for r in effects(kv[1], letters))), OUT)

"""A Python data source over an offset-paginated JSON service, with a response cache.

Executors fetch pages, `parallel` (1) of them at once. The service's interval between requests holds for all of them together: each reader gets
its own of `parallel` time slots, that far apart, when partitions are dealt. Responses are kept as gzipped JSON named by the hash of
their address, in a folder that all executors must share; a corrupt entry is a miss, and offline reads fail on a miss. Filters on columns
named in the option `push` reach the address. Hits and misses are carried out as rows: a column `_request` tells where a row's
page came from, and request_counts() counts them.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

PAGE, INTERVAL, BACKOFF = 1000, 0.34, (1, 2, 4, 8)
#: a column of a schema that gets where a row came from: hit or miss of the cache, and which request of its reader it was
REQUEST = "_request"


class SourceError(RuntimeError):
    pass


class Cache:
    def __init__(self, folder: str | None):
        self.folder, self.hits, self.misses = folder, 0, 0

    def path(self, url: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(url.encode()).hexdigest()[:32] + ".json.gz")

    def get(self, url: str):
        if self.folder:
            try:
                with gzip.open(self.path(url), "rt") as f:
                    found = json.load(f)
                self.hits += 1
                return found
            except (OSError, ValueError, EOFError):
                pass
        self.misses += 1
        return None

    def put(self, url: str, value) -> None:
        if self.folder:
            os.makedirs(self.folder, exist_ok=True)
            temporary = f"{self.path(url)}.{os.getpid()}"
            with gzip.open(temporary, "wt") as f:
                json.dump(value, f)
            os.replace(temporary, self.path(url))


class Pace:
    """The time slots of one of several readers: `step` seconds apart, the first after `lag`. Together they keep one interval."""

    def __init__(self, reader: int = 0, readers: int = 1, interval: float = INTERVAL, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.step, self.clock, self.sleep = interval * readers, clock, sleep
        self.next = clock() + interval * (reader + 1)

    def wait(self) -> None:
        now = self.clock()
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(self.next, now) + self.step


def get(url: str, cache: Cache, offline: bool = False, fetch: Callable[[str], tuple[int, str]] | None = None, sleep: Callable[[float], None] = time.sleep, pace: Pace | None = None) -> dict:
    """One response: cached, or fetched in a time slot, with retries on 429, server errors, broken connections and bodies that are not JSON."""
    found = cache.get(url)
    if found is not None:
        return found
    if offline:
        raise SourceError(f"not in the cache, and offline: {url}")
    last, pace = "", pace or Pace(sleep=sleep)
    for wait in (0, *BACKOFF):
        if wait:
            sleep(wait)
        pace.wait()
        try:
            status, body = (fetch or _http)(url)
        except OSError as problem:
            last = str(problem)
            continue
        if status == 200:
            try:
                value = json.loads(body)
            except ValueError:
                last = "the body is not JSON"
                continue
            cache.put(url, value)
            return value
        last = f"status {status}"
        if status != 429 and status < 500:
            break
    raise SourceError(f"{last}: {url}")


def _http(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=60) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as problem:
        return problem.code, ""


def pages(limit: int, total: int, page: int = PAGE) -> list[tuple[int, int]]:
    """(offset, size) of every page of min(limit, total) rows."""
    n = min(limit, total)
    return [(at, min(page, n - at)) for at in range(0, n, page)]


class Page(InputPartition):
    """Pages (offset, size) that one task fetches, one after the other, in the time slots of one of so many readers."""

    def __init__(self, parts: list[tuple[int, int]], reader: int = 0, readers: int = 1):
        self.parts, self.reader, self.readers = parts, reader, readers


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options
        self.key, self.limit = options["key"], int(options.get("limit", 8000))
        self.page, self.parallel = int(options.get("page", PAGE)), int(options.get("parallel", 1))
        self.push = dict(x.split("=", 1) for x in options.get("push", "").split(",") if x)
        self.terms: list[tuple[str, str]] = []

    def url(self, offset: int, size: int) -> str:
        base = self.options["path"]
        terms = urllib.parse.urlencode([*sorted(self.terms), ("limit", size), ("offset", offset)], safe=",")
        return f"{base}{'&' if '?' in base else '?'}{terms}"

    def _get(self, offset: int, size: int, cache: Cache | None = None, pace: Pace | None = None) -> dict:
        return get(self.url(offset, size), cache or Cache(self.options.get("cache")), self.options.get("offline", "false") == "true", pace=pace)

    def partitions(self):
        first = self._get(0, min(self.page, self.limit))
        total = (first.get("page_meta") or {}).get("total_count", len(first.get(self.key, [])))
        every = pages(self.limit, int(total), self.page)
        readers = min(self.parallel, len(every))
        return [Page(every[k::readers], k, readers) for k in range(readers)]

    def read(self, partition: Page) -> Iterator[tuple]:
        cache, pace = Cache(self.options.get("cache")), Pace(partition.reader, partition.readers)
        for offset, size in partition.parts:
            before = cache.hits
            rows = self._get(offset, size, cache, pace).get(self.key, [])
            request = f"{'hit' if cache.hits > before else 'miss'} {offset}"
            for row in rows:
                yield tuple(request if f.name == REQUEST else _value(row.get(f.name)) for f in self.schema)
            if len(rows) < size:  # a short page is the last
                return


class PushingReader(PagedReader):
    """With `push`; the session must allow pushdown (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, IN and IS NOT NULL on the columns of `push` (column=parameter,..) into the address; all else Spark applies."""
        for f in filters:
            name = self.push.get(f.attribute[0]) if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name is None:
                yield f
            elif isinstance(f, EqualTo):
                self.terms.append((name, str(f.value)))
            elif isinstance(f, In):
                self.terms.append((f"{name}__in", ",".join(map(str, f.value))))
            else:
                self.terms.append((f"{name}__isnull", "false"))


def _value(x):
    return json.dumps(x) if isinstance(x, (dict, list)) else x


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format('paged').schema(...).option('key', ...).load(address)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise SourceError("give the schema with .schema(...)")

    def reader(self, schema) -> PagedReader:
        return (PushingReader if self.options.get("push") else PagedReader)(schema, self.options)


def paged(spark: SparkSession, address: str, schema: str, key: str, push: dict[str, str] | None = None, limit: int = 8000, cache: str | None = None, offline: bool = False, page: int = PAGE, parallel: int = 1) -> DataFrame:
    """Rows of a paginated service; push maps columns to the parameters by which it filters on them."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"key": key, "limit": str(limit), "page": str(page), "parallel": str(parallel), "offline": str(offline).lower(), "push": ",".join(f"{a}={b}" for a, b in (push or {}).items())} | ({"cache": cache} if cache else {})
    return spark.read.format("paged").schema(schema).options(**options).load(address)


def request_counts(rows: DataFrame) -> DataFrame:
    """One row of what rows with a column `_request` say: n_requests that gave rows, n_hits of the cache, hit_rate (NULL of none)."""
    each = rows.select(REQUEST).where(F.col(REQUEST).isNotNull()).distinct()
    out = each.agg(F.count("*").alias("n_requests"), F.count_if(F.startswith(REQUEST, F.lit("hit"))).alias("n_hits"))
    return out.withColumn("hit_rate", F.try_divide(F.col("n_hits").cast("double"), F.col("n_requests")))


def batches(ids: DataFrame, column: str, size: int = 50) -> DataFrame:
    """(batch, ids) of the distinct, non-null ids in their order, `size` to a batch."""
    from ..operators.ranking import running_total

    once = ids.select(F.col(column).cast("string").alias("__id")).where("__id IS NOT NULL AND __id <> ''").distinct()
    placed = running_total(once, ["__id"], out="__i").withColumn("batch", F.floor(F.col("__i") / size))
    return placed.groupBy("batch").agg(F.array_sort(F.collect_list("__id")).alias("ids"))


def batched_lookup(ids: DataFrame, column: str, address: str, parameter: str, key: str, id_field: str, schema: str, size: int = 50, cache: str | None = None, offline: bool = False, parallel: int = 1) -> DataFrame:
    """Records (schema) of distinct ids, asked for `size` at a time; of several records of an id the last of its answer stays."""
    fields = [c.split() for c in schema.split(",")]
    names = [f[0] for f in fields]
    cell = lambda x, kind: None if x is None else str(_value(x)) if kind == "string" else _value(x)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        held, pace = Cache(cache), Pace(context.partitionId() % parallel if context else 0, parallel)
        for pdf in parts:
            found: dict = {}
            for batch, some in zip(pdf["batch"], pdf["ids"]):
                before = held.hits
                answer = get(f"{address}?{parameter}={','.join(some)}&limit={size}&offset=0", held, offline, pace=pace).get(key, [])
                request = f"{'hit' if held.hits > before else 'miss'} {batch}"
                for row in answer:
                    if row.get(id_field):
                        found[str(row[id_field])] = {**row, REQUEST: request}
            yield pd.DataFrame([[cell(r.get(n), kind) for n, kind in fields] for r in found.values()], columns=names, dtype=object)

    return batches(ids, column, size).repartition(parallel).mapInPandas(run, schema)


def cache_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row: n_entries, n_bytes of a response cache."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(folder)
    return files.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def fetch_text(url: str, folder: str, name: str, tries: int = 3, fetch: Callable[[str], tuple[int, str]] | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """A file's text, from the folder if it is there; else fetched with a few tries and put there."""
    path = os.path.join(folder, name)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    last = ""
    for k in range(tries):
        try:
            status, body = (fetch or _http)(url)
        except OSError as problem:
            status, body, last = 0, "", str(problem)
        if status == 200 and body:
            os.makedirs(folder, exist_ok=True)
            with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
                f.write(body)
            os.replace(f"{path}.{os.getpid()}", path)
            return body
        last = last or f"status {status}"
        sleep(BACKOFF[min(k, len(BACKOFF) - 1)])
    raise SourceError(f"{last}: {url}")

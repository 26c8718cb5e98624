"""Removal of repeated line runs by a suffix array over line-ID sequences, built by distributed prefix doubling.

A document is its sequence of non-blank lines (trimmed, inner white space squeezed for comparison only). Contract: wherever a
run of lines with at least `min_words` words stands more than once in the table, every line of all its copies but the first
goes; the order of copies is (doc_id, line). Runs may have any number of lines and may overlap.

1. Line IDs. Lines that stand once cannot be in a repeated run and are left behind. The others are sorted by range over the
   whole table; a line's place in that order is its rank at depth 1.
2. Doubling. The rank at depth 2h comes from sorting the pairs (rank of a suffix, rank of the suffix h lines further on) by
   range, across all documents. Pairs that stand once are unique suffixes and leave, and so does what contains them.
3. LCP intervals. Suffixes that share their first l lines, h < l <= 2h, are those with one pair (rank at depth h, rank at
   depth h of the suffix l - h lines further on). Each interval gives the place of its first member; the others are deleted.

Every line has a word at least, so runs of min_words lines always count and a longer run is the union of those in it: depths
beyond min_words lines decide nothing. Of the runs that count, only those that stop counting without their first or without
their last line are looked up; each maximal repeated run is a union of such. So lines that hold min_words words need depth 1
alone, and only short lines and their neighbours go through the doubling.

Only DataFrame functions are used. Rows exchanged are a few numbers a line; first places are summed map-side, and intervals
meet their rows in joins that adaptive execution can split. No task holds more of a document than its short lines' numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MIN_WORDS = 8
ODD = "\t\x0b\f\r"
DOC = ["doc_id", "t"]


def _squeezed(text: Column) -> Column:
    """text with every run of white space but line ends as one space; texts without any such run are left alone."""
    odd = F.contains(text, F.lit("  "))
    for c in ODD:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, "[\\t\\x0B\\f\\r ]{2,}|[\\t\\x0B\\f\\r]", " ")).otherwise(text)


def _words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, t, at, lo, w, near, a, b) of every non-blank line.

    t tells texts of one doc_id apart; at counts non-blank lines, lo all lines; w is the number of words; near: the line or one
    beside it has fewer than min_words; a and b are 128 bits that stand for the line.
    """
    some = F.filter(F.transform(F.split(_squeezed(F.col("text").cast("string")), "\n"), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("lo"))), lambda s: s["x"] != "")
    df = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), some.alias("lines"))
    df = df.select(*DOC, "lines", F.transform("lines", lambda s: _words(s["x"]) < min_words).alias("short"))
    short = lambda i: F.coalesce(F.get("short", i), F.lit(False))
    lines = F.transform("lines", lambda s, i: F.struct(s["x"].alias("x"), s["lo"].alias("lo"), (short(i) | short(i + 1) | short(i - 1)).alias("near")))
    df = df.select(*DOC, F.posexplode(lines).alias("at", "s"))
    return df.select(*DOC, "at", "s.lo", _words(F.col("s.x")).alias("w"), "s.near", F.xxhash64(F.lit(1), "s.x").alias("a"), F.xxhash64(F.lit(2), "s.x").alias("b"))


def place() -> Column:
    return F.struct(*DOC, "at")


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """(by, rank, first) of every key that stands at two places: its place in the order of all keys, and its first row's place.

    Ranks are sorted by range: they follow the order of the keys and are unique, though not gapless.
    """
    keys = rows.groupBy(*by).agg(F.min(place()).alias("first"), F.max(place()).alias("last")).where("first <> last").drop("last")
    return cut(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def _starts(short: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, t, at, need, rank): need holds (l, lo, hi) of the runs of l > 1 lines from here on that are to be looked up."""
    w = Window.partitionBy(*DOC).orderBy("at")
    rows = short.repartition(*DOC).dropDuplicates([*DOC, "at"])  # rows with one doc_id and one text are one document
    ahead = rows.select("*", *[F.when(F.lead("at", k).over(w) == F.col("at") + k, F.struct(F.lead("w", k).over(w).alias("w"), F.lead("lo", k).over(w).alias("lo"))).alias(f"n{k}") for k in range(1, min_words)])
    sums = [F.col("w")]
    for k in range(1, min_words):
        sums.append(sums[-1] + F.col(f"n{k}.w"))
    ahead = ahead.select(*DOC, "at", "lo", "w", "rank", *[F.col(f"n{k}.lo").alias(f"hi{k + 1}") for k in range(1, min_words)], *[s.alias(f"s{k + 1}") for k, s in enumerate(sums)])
    need = [
        F.when((F.col(f"s{n}") >= min_words) & ((F.col(f"s{n - 1}") < min_words) | (F.col(f"s{n}") - F.col("w") < min_words)), F.struct(F.lit(n).alias("l"), F.col("lo").alias("lo"), F.col(f"hi{n}").alias("hi")))
        for n in range(2, min_words + 1)
    ]
    return ahead.select(*DOC, "at", F.array_compact(F.array(*need)).alias("need"), "rank")


def _later(rows: DataFrame, lines: Column, hi: Column) -> DataFrame:
    """Spans of the rows that are not their interval's first."""
    span = F.struct("at", (F.col("at") + lines).alias("past"), "lo", hi.alias("hi"))
    return rows.where(place() > F.col("first")).select(*DOC, span.alias("span"))


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, span): later copies of runs; a span has at, past (of non-blank lines) and lo, hi (of all lines)."""
    lines = cut(lines_of(docs, min_words))
    lines = cut(lines.join(ranked(lines, "a", "b"), ["a", "b"]).drop("a", "b"))
    found = [_later(lines.where(F.col("w") >= min_words), F.lit(1), F.col("lo"))]
    if min_words > 1:
        rows, h = _starts(lines.where("near").select(*DOC, "at", "lo", "w", "rank"), min_words), 1
        w = Window.partitionBy(*DOC).orderBy("at")
        while h < min_words:

            def pair(n: int, h: int = h) -> Column:
                """The pair that names the run of n lines from here on, if all of it may be repeated; wanted: it is to be looked up."""
                there = F.when(F.lead("at", n - h).over(w) == F.col("at") + n - h, F.lead("rank", n - h).over(w))
                want = F.get(F.filter("need", lambda x: x["l"] == n), F.lit(0))
                return F.when(there.isNotNull() & (want.isNotNull() | (n == 2 * h)), F.struct(F.lit(n).alias("l"), there.alias("y"), want.alias("want")))

            pairs = rows.select(*DOC, "at", "need", F.col("rank").alias("x"), F.array(*[pair(n) for n in range(h + 1, min(2 * h, min_words) + 1)]).alias("p"))
            pairs = cut(pairs.select(*DOC, "at", "need", "x", F.explode(F.array_compact("p")).alias("p")).select(*DOC, "at", "need", "x", "p.*"))
            met = cut(pairs.join(ranked(pairs, "l", "x", "y"), ["l", "x", "y"]).select(*DOC, "at", "need", "l", "want", "rank", "first"))
            found.append(_later(met.where("want IS NOT NULL").select(*DOC, "at", "want.lo", "want.hi", "l", "first"), F.col("l"), F.col("hi")))
            rows = met.where(F.col("l") == 2 * h).select(*DOC, "at", "need", "rank")
            h *= 2
    return reduce(DataFrame.unionByName, found)


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, runs): maximal runs to delete, in order (at, past: among non-blank lines; lo, hi: among all), for documents with any."""
    mine = Window.partitionBy(*DOC).orderBy("span")
    rows = spans(docs, min_words).withColumn("reached", F.max("span.past").over(mine.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("span.at") <= F.col("reached"), 0).otherwise(1)).over(mine))
    runs = rows.groupBy(*DOC, "run").agg(F.min("span.at").alias("at"), F.max("span.past").alias("past"), F.min("span.lo").alias("lo"), F.max("span.hi").alias("hi"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("at", "past", "lo", "hi"))).alias("runs"))  # bounded by the document's own lines


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, detail: bool = False, drop_emptied: bool = False) -> DataFrame:
    """docs with later copies of repeated line runs deleted; all columns kept, n_chars brought up to date if present.

    drop_emptied: rows that lose all their lines (copies of earlier documents) go altogether; rows that were empty before stay.
    detail: instead (doc_id, n_lines, n_removed, n_runs, text), n_lines being non-blank lines and n_runs the maximal
    runs deleted. Null texts stay null and have no lines; blank lines always stay. Rows with one doc_id and one text are one
    document and get one result; a null doc_id sorts before all others. An empty table gives none. Documents that lose
    nothing keep their exact text. A text of any length is one row, and costs time in proportion to its length.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # so that no column's name can clash
    joined = rows.join(deletions(docs, min_words), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("t")), "left").select("row", "runs")
    old = F.col("row.text")
    joined = joined.withColumn("raw", F.when(F.col("runs").isNotNull() | F.lit(detail), F.split(old.cast("string"), "\n")))
    blank = lambda x: F.btrim(x, F.lit(" " + ODD)) == ""

    def piece(r: Column, k: Column) -> Column:
        """What stays of the lines from the end of the run before to the end of this one."""
        done = F.coalesce(F.get("runs", k - 1)["hi"] + 1, F.lit(0))
        return F.concat(F.slice("raw", done + 1, r["lo"] - done), F.filter(F.slice("raw", r["lo"] + 1, r["hi"] - r["lo"] + 1), blank))

    end = F.element_at("runs", -1)["hi"] + 1
    kept = F.concat(F.flatten(F.transform("runs", piece)), F.slice("raw", end + 1, F.size("raw")))
    text = F.when(F.col("runs").isNull(), old).otherwise(F.array_join(kept, "\n"))
    if detail:
        n_lines = F.coalesce(F.size(F.filter("raw", lambda x: ~blank(x))), F.lit(0))
        n_removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["past"] - r["at"]), F.lit(0))
        return joined.select("row.doc_id", F.when(old.isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"), F.coalesce(F.array_size("runs"), F.lit(0)).cast("long").alias("n_runs"), text.alias("text"))
    out = joined.select("row", "runs", text.alias("text"))
    if drop_emptied:
        out = out.where(F.col("runs").isNull() | ~blank(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))))
    length = lambda c: F.when(F.col("runs").isNull(), F.col(f"row.{c}")).otherwise(F.length("text")).cast(docs.schema[c].dataType).alias(c)
    return out.select(*[F.col("text") if c == "text" else length(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

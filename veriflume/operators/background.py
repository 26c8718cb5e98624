"""Balanced background sets: round-robin over sources, with exclusions and duplicates passed over without costing a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_total

MIN_COMPOUNDS, MIN_FAMILIES = 200, 3

def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; NULL keys are never duplicates. Keeps one row a key map-side, so hot keys do not gather."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("__r")).select("__r.*")
    return best.unionByName(df.where(F.col(key).isNull()))


def representatives(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, representative, n): the first row of each key by order; rows without a key stand for themselves."""
    known = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("representative"), F.count("*").alias("n"))
    return known.unionByName(df.where(F.col(key).isNull()).select(key, F.col(order).alias("representative"), F.lit(1).cast("long").alias("n")))


def exclude(df: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not known, one row n_excluded): a NULL key is never known."""
    keys = known.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi").agg(F.count("*").alias("n_excluded"))


def contributions(activities: DataFrame, per_source: int, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((source, molecule_id, smiles, seq) of the first per_source distinct molecules of every source, (source, reason) of those without any).

    activities: (source, molecule_id, smiles, seq, and error where a source could not be read). Rows without a molecule or structure
    do not count. sources: all that were asked for; one without rows failed too.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    error = F.col("error") if "error" in activities.columns else F.lit(None).cast("string")
    usable = activities.where(~blank("molecule_id") & ~blank("smiles") & error.isNull())
    first = usable.groupBy("source", "molecule_id").agg(F.min(F.struct("seq", "smiles")).alias("f")).select("source", "molecule_id", "f.smiles", "f.seq")
    kept = first.withColumn("__r", F.row_number().over(Window.partitionBy("source").orderBy("seq"))).where(F.col("__r") <= per_source).drop("__r")  # a top-k of each source: only so many rows a task go on
    seen = activities.groupBy("source").agg(F.max(error).alias("error"), F.count_if(~blank("molecule_id") & ~blank("smiles") & error.isNull()).alias("n"))
    if sources is not None:
        seen = activities.sparkSession.createDataFrame([(s,) for s in sources], "source string").join(seen, "source", "left")
    failed = seen.where(F.coalesce("n", F.lit(0)) == 0).select("source", F.coalesce("error", F.lit("no activities with structures")).alias("reason"))
    return kept, failed


def assemble(df: DataFrame, limit: int, exclude: DataFrame | None = None, source: str = "source", seq: str = "seq", key: str = "molecule_id", smiles: str | None = None) -> DataFrame:
    """Rows taken in turn from every source (by name), each source in seq order, up to limit, with turn.

    What is blank, excluded or taken already is passed over without costing the source its turn, so the balance is as even as the
    sources allow. At most `limit` molecules can be taken by other sources, so the first 2 * limit usable molecules of each source
    decide everything: these, and only these, go through the rotation on the driver.
    """
    chosen, _ = _rotate(df, limit, exclude, source, seq, key, smiles)
    picked = df.sparkSession.createDataFrame(chosen, _schema(df, source, seq, key))
    return df.join(F.broadcast(picked), [source, seq, key])  # at most `limit` rows


def _schema(df: DataFrame, source: str, seq: str, key: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (source, seq, key)) + ", turn int"


def _usable(df: DataFrame, smiles: str | None) -> DataFrame:
    return df if smiles is None else df.where(F.trim(F.coalesce(F.col(smiles), F.lit(""))) != "")


def _rotate(df: DataFrame, limit: int, exclude: DataFrame | None, source: str, seq: str, key: str, smiles: str | None) -> tuple[list[tuple], dict]:
    """(rows (source, seq, key, turn) in the order taken, {source: seq of the last row passed, None if all were})."""
    rows = _usable(df, smiles).where(F.col(key).isNotNull())
    rows = rows if exclude is None else rows.join(exclude.select(key).distinct(), key, "left_anti")
    first = rows.groupBy(source, key).agg(F.min(seq).alias(seq))
    rank = F.row_number().over(Window.partitionBy(source).orderBy(seq, key))
    queues: dict = {}
    for r in first.withColumn("__r", rank).where(F.col("__r") <= 2 * limit).orderBy(source, "__r").select(source, seq, key).toLocalIterator():
        queues.setdefault(r[0], []).append((r[1], r[2]))
    at, last, seen, chosen, turn = dict.fromkeys(queues, 0), {}, set(), [], 0
    while len(chosen) < limit:
        turn, before = turn + 1, len(chosen)
        for name in sorted(queues):
            if len(chosen) >= limit:
                break
            queue = queues[name]
            while at[name] < len(queue) and queue[at[name]][1] in seen:
                at[name] += 1
            if at[name] == len(queue):
                last[name] = None  # passed to its end
                continue
            place, molecule = queue[at[name]]
            at[name] += 1
            seen.add(molecule)
            chosen.append((name, place, molecule, turn))
            last[name] = place
        if len(chosen) == before:
            break
    return chosen, last


def account(df: DataFrame, limit: int, exclude: DataFrame | None = None, source: str = "source", seq: str = "seq", key: str = "molecule_id", smiles: str | None = None, family: str | None = None) -> DataFrame:
    """One row: n, per_source, per_family (maps), n_excluded, n_duplicates, usable of assemble()'s rotation.

    Excluded and duplicate rows count only as far as the rotation came to pass over them.
    """
    spark = df.sparkSession
    chosen, last = _rotate(df, limit, exclude, source, seq, key, smiles)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (source, seq))
    ends = spark.createDataFrame([(s, p) for s, p in last.items()], kinds).withColumnRenamed(seq, "__end")  # a row a source
    passed = _usable(df, smiles).join(F.broadcast(ends), source).where(F.col("__end").isNull() | (F.col(seq) <= F.col("__end")))
    out = exclude.select(F.col(key)).distinct().withColumn("__x", F.lit(True)) if exclude is not None else None
    passed = passed.withColumn("__x", F.lit(None).cast("boolean")) if out is None else passed.join(out, key, "left")
    counts = passed.agg(F.count_if("__x").alias("n_excluded"), F.count_if(F.col("__x").isNull()).alias("__rest")).first()
    per: dict = {}
    for s, *_ in chosen:
        per[s] = per.get(s, 0) + 1
    families: dict = {}
    if family:
        of = {r[0]: r[1] for r in df.groupBy(source).agg(F.min(family)).collect() if r[0] in per}  # a row a source
        for s, n in per.items():
            families[of[s] or "unclassified"] = families.get(of[s] or "unclassified", 0) + n
    usable_ = len(chosen) >= MIN_COMPOUNDS and len(families or per) >= MIN_FAMILIES
    row = (len(chosen), {str(k): v for k, v in per.items()}, {str(k): v for k, v in families.items()}, counts["n_excluded"], counts["__rest"] - len(chosen), usable_)
    return spark.createDataFrame([row], "n long, per_source map<string,long>, per_family map<string,long>, n_excluded long, n_duplicates long, usable boolean")


def usable(df: DataFrame, family: str = "family") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_distinct(family).alias("n_families")).withColumn("usable", (F.col("n") >= MIN_COMPOUNDS) & (F.col("n_families") >= MIN_FAMILIES))


def place_within(df: DataFrame, by: str, order: str, out: str) -> DataFrame:
    """df with the 1-based place of each row within its group, in a total order, without a group in one task.

    Places among all rows by (group, order), less what comes before the group: groups may be few and large.
    """
    placed = running_total(df, [by, order], out="__p")
    starts = placed.groupBy(F.col(by).alias("__by")).agg(F.min("__p").alias("__s"))
    return placed.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("__by"))).withColumn(out, F.col("__p") - F.col("__s") + 1).drop("__p", "__by", "__s")

def interleave(df: DataFrame, label: str = "label", seq: str = "seq") -> DataFrame:
    """df with position: labels in turn, the larger group first, then the first seen; both orders follow seq. Labels are few: a row of each is broadcast."""
    sizes = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"), F.min(seq).alias("__f"))
    ranked = place_within(df, label, seq, "rn").join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("__l")))
    return running_total(ranked, ["rn", F.desc("__n"), "__f"]).withColumn("position", F.col("before") + 1).drop("__n", "__f", "__l", "before")


def shard(df: DataFrame, n_shards: int, index: int, label: str = "label", seq: str = "seq") -> DataFrame:
    """Every n-th member of each label, interleaved."""
    return interleave(place_within(df, label, seq, "__rn").where(F.pmod(F.col("__rn") - 1, F.lit(n_shards)) == index).drop("__rn"), label, seq)

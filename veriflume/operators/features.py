"""Feature prevalence, profiles against a background, and verdicts that are withheld where nothing discriminates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVALENT, RATIO, DISCRIMINATING, MIN_BACKGROUND, MIN_ACTIVES = 0.8, 1.5, 3.0, 10, 10


def prevalence(df: DataFrame, features: list[str], counts: str = "counts") -> DataFrame:
    """(feature, prevalence, n): share of parseable rows (counts not NULL) with the feature; absent features are there with 0.

    Rows are exploded into the features that they have, once, and those are counted: what a row costs is what it has.
    """
    parsed = df.where(F.col(counts).isNotNull())
    total = parsed.agg(F.count("*").alias("n"))
    having = parsed.select(F.explode(F.map_keys(F.map_filter(counts, lambda k, v: v > 0))).alias("feature")).groupBy("feature").agg(F.count("*").alias("k"))
    names = F.broadcast(df.sparkSession.createDataFrame([(f,) for f in features], "feature string"))
    return names.join(having, "feature", "left").crossJoin(F.broadcast(total)).select("feature", F.coalesce(F.try_divide(F.coalesce("k", F.lit(0)).cast("double"), F.col("n")), F.lit(0.0)).alias("prevalence"), "n")  # a row a feature, and one


def profile(actives: DataFrame, background: DataFrame | None = None, threshold: float = PREVALENT, ratio: float = RATIO) -> DataFrame:
    """(feature, prevalence, background_prevalence, enrichment, kind, can_discriminate, strong) from two prevalence tables.

    kind: conserved, ubiquitous or NULL. enrichment is infinite where the background lacks the feature, NULL where both do
    or there is no background of MIN_BACKGROUND rows.
    """
    if background is None:
        df = actives.withColumn("background_prevalence", F.lit(None).cast("double")).withColumn("nb", F.lit(0))
    else:
        df = actives.join(background.select("feature", F.col("prevalence").alias("background_prevalence"), F.col("n").alias("nb")), "feature", "left")
    has = F.coalesce(F.col("nb"), F.lit(0)) >= MIN_BACKGROUND
    b = F.coalesce("background_prevalence", F.lit(0.0))
    enrichment = F.when(has & (b > 0), F.col("prevalence") / b).when(has & (F.col("prevalence") > 0), F.lit(float("inf")))
    kind = F.when(F.col("prevalence") < threshold, None).when(~has | (b <= 0) | (F.col("prevalence") / b >= ratio), "conserved").otherwise("ubiquitous")
    df = df.withColumn("has_background", has).withColumn("enrichment", enrichment).withColumn("kind", kind)
    capped = F.when(F.col("enrichment") == float("inf"), 1000.0).otherwise(F.col("enrichment"))
    best = df.agg(F.max(F.when(F.col("kind") == "conserved", capped)).alias("best"))
    df = df.crossJoin(F.broadcast(best))  # one row
    can = F.col("has_background") & F.coalesce(F.col("best") >= DISCRIMINATING, F.lit(False))
    strong = (F.col("kind") == "conserved") & F.when(~F.col("has_background"), F.lit(True)).otherwise(can & F.coalesce(capped >= F.col("best") / 2, F.lit(False)))
    return df.select("feature", "prevalence", "n", "background_prevalence", "enrichment", "kind", can.alias("can_discriminate"), F.coalesce(strong, F.lit(False)).alias("strong"), "has_background")


def check(candidates: DataFrame, conserved: list[str], strong: list[str], informative: bool, counts: str = "counts") -> DataFrame:
    """candidates with present, missing, strong_present, duplicated and error; withheld verdicts say so, they do not fail."""
    names = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<string>")
    has: Column = F.map_keys(F.map_filter(F.col(counts), lambda k, v: v > 0))
    error = F.lit("withheld: no profile that discriminates") if not informative else F.when(F.col(counts).isNull(), "not parseable")
    fine = error.isNull() if informative else F.lit(False)
    empty = F.array().cast("array<string>")
    out = candidates.withColumn("error", error.cast("string"))
    pick = lambda c: F.when(fine, c).otherwise(empty)
    return (
        out.withColumn("present", pick(F.array_sort(F.array_intersect(names(conserved), has)))).withColumn("missing", pick(F.array_sort(F.array_except(names(conserved), has))))
        .withColumn("strong_present", pick(F.array_sort(F.array_intersect(names(strong), has))))
        .withColumn("duplicated", F.when(fine, F.map_filter(F.col(counts), lambda k, v: (v > 1) & F.array_contains(names(strong), k))))
    )


def screen_counts(checked: DataFrame) -> DataFrame:
    """One row: n, n_retaining, n_flagged (none of the conserved features, and no error), n_weak_only, n_duplicated of check()'s rows."""
    any_, strong = F.size("present") > 0, F.size("strong_present") > 0
    return checked.agg(
        F.count("*").alias("n"), F.count_if(any_).alias("n_retaining"), F.count_if(~any_ & F.col("error").isNull()).alias("n_flagged"),
        F.count_if(any_ & ~strong).alias("n_weak_only"), F.count_if(F.coalesce(F.size("duplicated"), F.lit(0)) > 0).alias("n_duplicated"),
    )


def screen(candidates: DataFrame, actives: DataFrame, background: DataFrame | None, features: list[str], threshold: float = PREVALENT, ratio: float = RATIO) -> tuple[DataFrame, DataFrame]:
    """(profile, checked candidates): actives (counts) profiled against a background, then every candidate checked by the profile."""
    p = profile(prevalence(actives, features), None if background is None else prevalence(background, features), threshold, ratio).cache()
    rows = p.collect()  # a row a feature
    conserved = [r["feature"] for r in rows if r["kind"] == "conserved"]
    informative = bool(rows) and rows[0]["n"] >= MIN_ACTIVES
    return p, check(candidates, conserved, [r["feature"] for r in rows if r["strong"]], informative)


def two_sided(profiled: DataFrame, anchors: list[str], incidental: list[str], floor: float = DISCRIMINATING) -> DataFrame:
    """One row: the best enrichment among expected anchors and among incidental features (infinity as 1000), and whether a floor separates them."""
    value = F.when(F.col("enrichment") == float("inf"), 1000.0).otherwise(F.col("enrichment"))
    best = lambda names: F.coalesce(F.max(F.when(F.col("feature").isin(names) & (F.col("prevalence") > 0), value)), F.lit(0.0))
    out = profiled.agg(best(anchors).alias("anchor"), best(incidental).alias("incidental"))
    verdict = F.when((F.col("anchor") >= floor) & (F.col("incidental") < floor), "separates").when(F.col("anchor") >= floor, "enriches everything").otherwise("nothing stands out")
    return out.withColumn("verdict", verdict)

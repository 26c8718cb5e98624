"""Curation: ordered rules with a reason for every dropped row, then aggregation of replicates.

Every input row ends in one kept group or one named rejection. Policies are Python configuration that build Columns. Rows are
judged once: what both points and rejections need is written to the scratch folder, so that no filter above takes the whole
chain of rules into its condition and evaluates it again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..session import cut


@dataclass(frozen=True)
class CurationPolicy:
    min_confidence: int | None = 8
    assay_types: tuple[str, ...] = ("B", "F")
    families: tuple[str, ...] = ("functional",)
    drop_flagged: bool = True
    drop_duplicates: bool = True
    require_structure: bool = True
    exact_relation: bool = True
    plausible: tuple[float, float] = units.PLAUSIBLE
    pchembl_tolerance: float | None = 0.1


#: keeps whatever can be converted and has a structure, for a look at what the default drops
PERMISSIVE = CurationPolicy(None, (), (), False, False, pchembl_tolerance=None)


@dataclass(frozen=True)
class AggregationPolicy:
    max_spread: float = 1.0
    min_measurements: int = 1
    statistic: str = "median"
    spread_as_uncertainty: bool = True

    def __post_init__(self):
        if self.max_spread < 0 or self.min_measurements < 1 or self.statistic not in ("median", "mean"):
            raise ValueError("invalid aggregation policy")


def blank(c: Column) -> Column:
    return units.strip(F.coalesce(c, F.lit(""))) == ""


def apply_rules(records: DataFrame, policy: CurationPolicy = CurationPolicy()) -> DataFrame:
    """records with pactivity, reason (of a refused conversion) and rule: the first rule that fails, or NULL."""
    df = units.converted(records, keep_steps=True)
    p, low, high = F.col("pactivity"), *policy.plausible
    df = df.withColumns({"__assay": F.upper(units.strip(F.coalesce("assay_type", F.lit("")))), "__family": units.family_of(F.col("__t")), "__off": F.abs(p - F.col("pchembl_value"))})
    rules = {
        "missing_structure": blank(F.col("smiles")) if policy.require_structure else None,
        "low_target_confidence": F.coalesce(F.col("confidence_score") < policy.min_confidence, F.lit(True)) if policy.min_confidence is not None else None,
        "wrong_assay_type": ~F.col("__assay").isin(list(policy.assay_types)) if policy.assay_types else None,
        "incommensurable_endpoint": ~F.coalesce(F.col("__family").isin(list(policy.families)), F.lit(False)) if policy.families else None,
        "source_flagged_invalid": ~blank(F.col("data_validity_comment")) if policy.drop_flagged else None,
        "potential_duplicate": F.coalesce("potential_duplicate", F.lit(False)) if policy.drop_duplicates else None,
        "censored_measurement": ~F.col("__r").isin("=", "==") if policy.exact_relation else None,
        "unconvertible_value": p.isNull(),
        "implausible_pactivity": ~p.between(low, high),
        "pchembl_disagreement": F.coalesce(F.col("__off") > policy.pchembl_tolerance, F.lit(False)) if policy.pchembl_tolerance is not None else None,
    }
    rule = F.coalesce(*[F.when(fails, name) for name, fails in rules.items() if fails is not None])
    return df.withColumn("rule", rule).drop(*units.STEPS, "__assay", "__family", "__off")


def with_details(ruled: DataFrame, policy: CurationPolicy = CurationPolicy()) -> DataFrame:
    """Rows of apply_rules() with detail: their rule in words, with what it was that failed. Meant for rejected rows, and made only where it is read."""
    p, c, kind = F.col("pactivity"), F.col("confidence_score"), F.col("activity_type")
    quoted = lambda before, x, after: F.concat(F.lit(f"{before} '"), F.coalesce(x, F.lit("")), F.lit(f"'{after}"))
    listed, (low, high), relation = lambda xs: ", ".join(sorted(xs)), policy.plausible, units.exact(F.col("relation"))
    assay, family = F.upper(units.strip(F.coalesce("assay_type", F.lit("")))), units.family_of(units.strip(kind))
    words = {
        "missing_structure": F.lit("no structure is given"),
        "low_target_confidence": F.when(c.isNull(), "no confidence score").otherwise(F.concat(F.lit("confidence "), c.cast("string"), F.lit(f" is under {policy.min_confidence}"))),
        "wrong_assay_type": F.when(assay == "", "no assay type").otherwise(quoted("assay type", assay, f" is none of {listed(policy.assay_types)}")),
        "incommensurable_endpoint": F.when(family.isNull(), quoted("type", kind, " is of no known family")).otherwise(quoted("family", family, f" is none of {listed(policy.families)}")),
        "source_flagged_invalid": quoted("the source says", units.strip(F.col("data_validity_comment")), ""),
        "potential_duplicate": F.lit("the source takes it for a repeated measurement"),
        "censored_measurement": quoted("relation", relation, " is a bound, not a value"),
        "unconvertible_value": units.refusal(F.col("reason"), F.col("unit"), relation, F.col("value")),
        "implausible_pactivity": F.format_string(f"pActivity %.2f is not within {low} to {high}", p),
        "pchembl_disagreement": F.format_string("pActivity %.2f, but %.2f by the source", p, "pchembl_value"),
    }
    return ruled.withColumn("detail", F.coalesce(*[F.when(F.col("rule") == name, text) for name, text in words.items()]))


def _key(records: DataFrame, key: str | Column) -> tuple[DataFrame, str]:
    """records with the compound key as a column, and its name: a column of that name, or any Column over the records."""
    return (records, key) if isinstance(key, str) else (records.withColumn("compound_key", key), "compound_key")


def aggregate(kept: DataFrame, policy: AggregationPolicy = AggregationPolicy(), key: str | Column = "compound_id") -> DataFrame:
    """One row per (key, target): counts, spread, statistic, members in seq order, and the group's rule or NULL.

    A group's members are listed once, in seq order, and all else follows from the list: a compound's replicates are few.
    """
    kept, key = _key(kept, key)
    members = F.array_sort(F.collect_list(F.struct("seq", "activity_id", "pactivity", "smiles", "activity_type"))).alias("__m")
    rows = kept.groupBy(key, "target_id").agg(F.count("*").alias("n_measurements"), (F.max("pactivity") - F.min("pactivity")).alias("spread"), F.avg("pactivity").alias("__mean"), members)
    rows = rows.withColumn("__v", F.array_sort("__m.pactivity"))
    half = lambda i: F.element_at("__v", F.floor(i / 2).cast("int"))
    middle = (half(F.col("n_measurements") + 1) + half(F.col("n_measurements") + 2)) / 2
    out = rows.select(
        key, "target_id", "n_measurements", "spread", (middle if policy.statistic == "median" else F.col("__mean")).alias("pactivity"), F.col("__m")[0]["smiles"].alias("smiles"),
        F.col("__m.activity_id").alias("source_activity_ids"), F.array_sort(F.array_distinct("__m.activity_type")).alias("activity_types"),
    )

    rule = F.when(F.col("n_measurements") < policy.min_measurements, "too_few_replicates").when(F.col("spread") > policy.max_spread, "irreconcilable_replicates")
    uncertainty = F.when(F.col("n_measurements") > 1, F.col("spread") / 2) if policy.spread_as_uncertainty else F.lit(None).cast("double")
    return out.withColumn("uncertainty", uncertainty).withColumn("rule", rule)


def group_details(policy: AggregationPolicy, n: Column, spread: Column) -> tuple[Column, Column]:
    """(rule, detail) of a group's members, from its size and spread; both NULL if it stands."""
    few, apart = n < policy.min_measurements, spread > policy.max_spread
    rule = F.when(few, "too_few_replicates").when(apart, "irreconcilable_replicates")
    return rule, F.when(few, F.concat(n.cast("string"), F.lit(f" of the {policy.min_measurements} measurements needed"))).when(apart, F.format_string(f"%d measurements lie %.2f log units apart, over {policy.max_spread}", n, spread))


NEEDED = ["activity_id", "seq", "compound_id", "target_id", "smiles", "activity_type", "pactivity", "rule"]
WORDED = ["reason", "value", "unit", "relation", "assay_type", "confidence_score", "data_validity_comment", "pchembl_value"]


def curate(records: DataFrame, policy: CurationPolicy = CurationPolicy(), aggregation: AggregationPolicy = AggregationPolicy(), key: str | Column = "compound_id") -> tuple[DataFrame, DataFrame]:
    """(points, rejections): points in no order (in_order() sorts them at the edge), rejections one row per rejected record.

    Rejected groups' members are found by a window over the group, so no join back is needed.
    """
    ruled, key = _key(apply_rules(records, policy), key)
    ruled = cut(ruled.select(*dict.fromkeys([*NEEDED, *WORDED, key])))
    kept = ruled.where("rule IS NULL").select(*dict.fromkeys([*NEEDED, key])).drop("rule")
    points = aggregate(kept, aggregation, key).where("rule IS NULL").drop("rule")
    w = Window.partitionBy(key, "target_id")
    grouped = kept.withColumns({"__n": F.count("*").over(w), "__s": F.max("pactivity").over(w) - F.min("pactivity").over(w)})
    rule, detail = group_details(aggregation, F.col("__n"), F.col("__s"))
    grouped = grouped.withColumns({"rule": rule, "detail": detail})
    columns = ["activity_id", "seq", "compound_id", "target_id", "rule", "detail"]
    return points, with_details(ruled.where("rule IS NOT NULL"), policy).select(*columns).unionByName(grouped.where("rule IS NOT NULL").select(*columns))


def accounting(records: DataFrame, policy: CurationPolicy = CurationPolicy(), aggregation: AggregationPolicy = AggregationPolicy(), key: str | Column = "compound_id") -> DataFrame:
    """One row: n_input, n_points, n_kept_measurements, n_rejected, retention (NULL without input), balanced (nothing lost).

    One pass: sizes and spreads of groups with their own rejected records beside them, then their sums.
    """
    ruled, key = _key(apply_rules(records, policy), key)
    fine = F.col("rule").isNull()
    p = F.when(fine, F.col("pactivity"))
    per = ruled.groupBy(key, "target_id").agg(F.count_if(fine).alias("k"), F.count("rule").alias("r"), (F.max(p) - F.min(p)).alias("s"))
    good = (F.col("k") > 0) & (F.col("k") >= aggregation.min_measurements) & (F.col("s") <= aggregation.max_spread)
    none = F.lit(0).cast("long")
    out = per.agg(F.coalesce(F.sum(F.col("k") + F.col("r")), none).alias("n_input"), F.count_if(good).alias("n_points"), F.coalesce(F.sum(F.when(good, F.col("k"))), none).alias("n_kept_measurements"), F.coalesce(F.sum(F.col("r") + F.when(good, 0).otherwise(F.col("k"))), none).alias("n_rejected"))
    return out.withColumn("retention", F.try_divide(F.col("n_input") - F.col("n_rejected"), F.col("n_input"))).withColumn("balanced", F.col("n_kept_measurements") + F.col("n_rejected") == F.col("n_input"))


def summary(rejections: DataFrame, seq: str = "seq") -> DataFrame:
    """(rule, n), the most frequent first, ties by which rule was met first in the records' order."""
    first = F.min(seq) if seq in rejections.columns else F.min("rule")
    return rejections.groupBy("rule").agg(F.count("*").alias("n"), first.alias("__first")).orderBy(F.desc("n"), "__first", "rule").drop("__first")


def in_order(points: DataFrame, key: str = "compound_id") -> DataFrame:
    """Points by target and compound: the order of output files. A sort of everything, so only at the edge."""
    return points.orderBy("target_id", key)


# Potencies that make a compound active, a possible decoy, or part of a background.
ACTIVE_FROM, DECOY_TO, BACKGROUND_TO = 8.0, 5.5, 6.0


def potency(points: DataFrame, at_least: float | None = None, at_most: float | None = None, column: str = "pactivity") -> DataFrame:
    """Points within potency bounds, both inclusive; unknown potencies are in none."""
    out = points.where(F.col(column).isNotNull())
    out = out if at_least is None else out.where(F.col(column) >= at_least)
    return out if at_most is None else out.where(F.col(column) <= at_most)


def most_potent(points: DataFrame, k: int, *ties: str, column: str = "pactivity") -> DataFrame:
    """The k most potent points, ties by the columns given (compound_id): a bounded top-k."""
    return points.where(F.col(column).isNotNull()).orderBy(F.desc(column), *(ties or ("compound_id",))).limit(k)

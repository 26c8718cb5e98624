"""Quantities: values with an origin, a source and what is known of their uncertainty, as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import lookup

#: from the strongest origin to the weakest
ORIGINS = ["measured", "derived", "predicted", "heuristic"]
SCHEMA = "struct<value: double, unit: string, origin: string, source: string, uncertainty: double, in_domain: boolean, notes: array<string>>"


def quantity(value: Column, origin: str | Column, unit: Column | None = None, source: Column | None = None, uncertainty: Column | None = None, in_domain: Column | None = None, notes: Column | None = None) -> Column:
    none = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return F.struct(
        none(value, "double").alias("value"), none(unit, "string").alias("unit"), (F.lit(origin) if isinstance(origin, str) else origin).alias("origin"), none(source, "string").alias("source"),
        none(uncertainty, "double").alias("uncertainty"), none(in_domain, "boolean").alias("in_domain"), (F.array().cast("array<string>") if notes is None else notes).alias("notes"),
    )


def problem(q: Column) -> Column:
    """Why a quantity may not exist, or NULL."""
    return (
        F.when((q["origin"] == "measured") & (F.coalesce(q["source"], F.lit("")) == ""), "measured without source")
        .when(F.isnan(q["value"]) | (F.abs(q["value"]) == float("inf")), "not finite")
        .when(q["uncertainty"] < 0, "negative uncertainty")
        .when(q["uncertainty"].isNotNull() & q["value"].isNull(), "uncertainty without value")
        .when(q["in_domain"].isNotNull() & (q["origin"] != "predicted"), "domain of a non-prediction")
    )


def checked(q: Column) -> Column:
    return F.when(problem(q).isNull(), q).otherwise(F.raise_error(problem(q)).cast(SCHEMA))


def rank(origin: Column) -> Column:
    return lookup({o: i for i, o in enumerate(ORIGINS)}, origin)


def weakest(*origins: Column) -> Column:
    if not origins:
        raise ValueError("the weakest of nothing is undefined")
    return F.element_at(F.array(*map(F.lit, ORIGINS)), F.greatest(*map(rank, origins), F.lit(-1)) + 1)


def is_known(q: Column) -> Column:
    return q["value"].isNotNull()


def is_rankable(q: Column) -> Column:
    return is_known(q) & (q["origin"].isin("measured", "derived") | (q["origin"] == "predicted") & F.coalesce(q["in_domain"], F.lit(False)))


def map_value(q: Column, value: Column, origin: str, source: Column, note: str | None = None) -> Column:
    """A quantity computed from another: never stronger than it, its uncertainty gone, its source chained."""
    now = weakest(q["origin"], F.lit(origin))
    known = quantity(value, now, q["unit"], F.concat(source, F.lit(" <- "), F.coalesce(q["source"], F.lit(""))), None, F.when(now == "predicted", q["in_domain"]), F.concat(q["notes"], F.array(F.lit(note))) if note else q["notes"])
    lost = quantity(None, F.when(q["origin"] == "measured", "derived").otherwise(q["origin"]), q["unit"], q["source"], None, None, F.concat(q["notes"], F.array(F.lit("propagated unknown"))))
    return F.when(is_known(q), known).otherwise(lost)


def require(q: Column) -> Column:
    return F.when(is_known(q), q["value"]).otherwise(F.raise_error(F.lit("a required value is unknown")).cast("double"))


def or_else(q: Column, default: Column) -> Column:
    return F.coalesce(q["value"], default)


def with_notes(q: Column, *notes: str) -> Column:
    """The quantity with more notes after its own."""
    return q.withField("notes", F.concat(q["notes"], F.array(*map(F.lit, notes))))


def label(q: Column) -> Column:

    shown = F.concat(
        F.format_string("%.3f", q["value"]), F.when(q["uncertainty"].isNotNull(), F.format_string(" ± %.3f", q["uncertainty"])).otherwise(""), F.when(F.coalesce(q["unit"], F.lit("")) != "", F.concat(F.lit(" "), q["unit"])).otherwise(""),
        F.lit(" ["), q["origin"], F.when(q["in_domain"] == F.lit(False), ", OUT OF DOMAIN").otherwise(""), F.lit("]"),
    )
    return F.when(is_known(q), shown).otherwise("not computed")


def to_json(q: Column) -> Column:
    return F.to_json(q, {"ignoreNullFields": "false"})


def from_json(text: Column) -> Column:
    return F.from_json(text, SCHEMA)

"""Unit normalisation and pActivity: one CASE for the value, one for the reason of a refusal.

Tables are converted by converted(), in steps of one projection each: what a later step uses several times is a column by then,
so neither the plan nor the generated code grows with the number of uses. pactivity() builds the same as two Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units and activity types with a defined meaning.
TO_MOLAR = {"m": 1.0, "mm": 1e-3, "um": 1e-6, "nm": 1e-9, "pm": 1e-12, "fm": 1e-15}
TO_GRAMS_PER_LITRE = {"g.l-1": 1.0, "mg.l-1": 1e-3, "ug.l-1": 1e-6, "ng.l-1": 1e-9, "g.ml-1": 1000.0, "mg.ml-1": 1.0, "ug.ml-1": 1e-3, "ng.ml-1": 1e-6}
NOT_CONCENTRATIONS = ["%", "percent", "ratio", "mg.kg-1", "ug.kg-1", "mol.kg-1", "ml.min-1.kg-1", "h", "hr", "min", "s", "l.kg-1", "ug", "mg", "counts", "fold", "ph", "degrees c", "kcal/mol", "kj/mol"]
ALREADY_LOG = ["pIC50", "pEC50", "pKi", "pKd", "pA2", "pKB", "Log IC50", "Log Ki"]
FAMILIES = {
    "binding": ["Ki", "Kd", "KD", "pKi", "pKd"],
    "functional": ["IC50", "EC50", "XC50", "AC50", "pIC50", "pEC50"],
    "antimicrobial": ["MIC", "MIC50", "MBC"],
    "cellular_growth": ["GI50", "CC50", "TD50", "LC50"],
}
PLAUSIBLE = (2.0, 12.0)


# The characters that count as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """All white space off both ends (trim() knows blanks only)."""
    return F.btrim(c, F.lit(WHITE))

def lookup(table: dict[str, float | str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalise_unit(unit: Column) -> Column:
    out = F.lower(strip(F.coalesce(unit, F.lit(""))))
    for old, new in (("µ", "u"), ("μ", "u"), (" ", ""), ("/l", ".l-1"), ("/ml", ".ml-1"), ("/kg", ".kg-1")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def is_concentration_unit(unit: Column) -> Column:
    return normalise_unit(unit).isin(list(TO_MOLAR))


def to_molar(value: Column, unit: Column) -> Column:
    return value * lookup(TO_MOLAR, normalise_unit(unit))


def mass_per_litre_to_molar(value: Column, unit: Column, weight: Column) -> Column:
    """NULL when the unit is not mass per volume; a weight that is missing or not positive gives NULL (callers refuse first)."""
    return F.when(weight > 0, value * lookup(TO_GRAMS_PER_LITRE, normalise_unit(unit)) / weight)


def family_of(activity_type: Column) -> Column:
    return lookup({t: family for family, types in FAMILIES.items() for t in types}, activity_type)


def _reason(value: Column, relation: Column, is_log: Column, norm: Column, massive: Column, weight: Column, molar: Column) -> Column:
    """Why a value is refused, tried in a fixed order; NULL where it is not. Non-finite values count as missing."""
    return (
        F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "no value")
        .when(~relation.isin("=", "=="), "censored")
        .when(is_log, None)
        .when(norm.isin(NOT_CONCENTRATIONS), "not a concentration")
        .when(massive & (weight.isNull() | (weight <= 0)), "needs molecular weight")
        .when(molar.isNull(), "unrecognised unit")
        .when(molar <= 0, "non-positive")
    )


def exact(relation: Column) -> Column:
    """A relation without white space; none is '='."""
    return strip(F.when(F.coalesce(relation, F.lit("")) == "", "=").otherwise(relation))


def pactivity(value: Column, unit: Column, activity_type: Column, relation: Column, weight: Column) -> tuple[Column, Column]:
    """(pactivity, reason): exactly one of them is NULL."""
    norm, is_log = normalise_unit(unit), strip(F.coalesce(activity_type, F.lit(""))).isin(ALREADY_LOG)
    molar = F.coalesce(to_molar(value, unit), mass_per_litre_to_molar(value, unit, weight))
    reason = _reason(value, exact(relation), is_log, norm, lookup(TO_GRAMS_PER_LITRE, norm).isNotNull(), weight, molar)
    return F.when(reason.isNull(), F.when(is_log, value).otherwise(-F.log10(molar))), reason


STEPS = ["__u", "__t", "__r", "__f", "__g", "__log", "__molar"]


def converted(df: DataFrame, keep_steps: bool = False) -> DataFrame:
    """df (value, unit, activity_type, relation, molecular_weight) with pactivity and reason, exactly one of which is NULL.

    keep_steps: also the normalised unit (__u), type (__t) and relation (__r) and the molar value (__molar), for what follows.
    """
    df = df.withColumns({"__u": normalise_unit(F.col("unit")), "__t": strip(F.coalesce("activity_type", F.lit(""))), "__r": exact(F.col("relation"))})
    df = df.withColumns({"__f": lookup(TO_MOLAR, F.col("__u")), "__g": lookup(TO_GRAMS_PER_LITRE, F.col("__u")), "__log": F.col("__t").isin(ALREADY_LOG)})
    df = df.withColumn("__molar", F.coalesce(F.col("value") * F.col("__f"), F.when(F.col("molecular_weight") > 0, F.col("value") * F.col("__g") / F.col("molecular_weight"))))
    df = df.withColumn("reason", _reason(F.col("value"), F.col("__r"), F.col("__log"), F.col("__u"), F.col("__g").isNotNull(), F.col("molecular_weight"), F.col("__molar")))
    df = df.withColumn("pactivity", F.when(F.col("reason").isNull(), F.when(F.col("__log"), F.col("value")).otherwise(-F.log10("__molar"))))
    return df if keep_steps else df.drop(*STEPS)


def refusal(reason: Column, unit: Column, relation: Column, value: Column) -> Column:
    """What a reason means for a row: the unit or relation that was refused is in the text."""
    quoted = F.concat(F.lit("unit '"), F.coalesce(unit, F.lit("")), F.lit("'"))
    return (
        F.when(reason == "no value", "no value is given")
        .when(reason == "censored", F.concat(F.lit("relation '"), relation, F.when(relation.startswith(">"), "' gives an upper bound only").otherwise("' gives a lower bound only")))
        .when(reason == "not a concentration", F.concat(quoted, F.lit(" is no concentration")))
        .when(reason == "needs molecular weight", F.concat(quoted, F.lit(" cannot be made molar without a molecular weight")))
        .when(reason == "unrecognised unit", F.concat(quoted, F.lit(" is not known")))
        .when(reason == "non-positive", F.concat(value.cast("string"), F.lit(" has no logarithm")))
    )


def citation(activity_id: Column, assay_id: Column, target_id: Column) -> Column:
    """Where a measurement comes from: its id, assay and target, as far as they are known."""
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws(" / ", F.coalesce(given(activity_id), F.lit("unknown-activity")), F.concat(F.lit("assay "), given(assay_id)), F.concat(F.lit("target "), given(target_id)))


def as_quantity(source: Column) -> Column:
    """The quantity of a row of converted(df, keep_steps=True): derived, with how it came about, or unknown with the refusal."""
    from .quantity import quantity

    known = F.col("reason").isNull()
    how = F.when(F.col("__log"), F.concat(F.col("__t"), F.lit(" is a logarithm already"))).otherwise(F.format_string("-log10 of %.3e M", "__molar"))
    notes = F.array_compact(F.array(
        F.concat(F.lit("type "), F.when(F.col("__t") == "", "unspecified").otherwise(F.col("__t"))), F.when(~F.col("__log"), F.concat(F.lit("from "), F.col("value").cast("string"), F.lit(" "), F.col("unit"))),
        F.when(~is_plausible(F.col("pactivity")), F.format_string("%.2f is not plausible: the unit may be wrong", "pactivity")),
    ))
    text = F.concat(source, F.lit(": "), F.when(known, how).otherwise(refusal(F.col("reason"), F.col("unit"), F.col("__r"), F.col("value"))))
    return quantity(F.col("pactivity"), "derived", None, text, None, None, F.when(known, notes).otherwise(F.array().cast("array<string>")))

def is_plausible(p: Column) -> Column:
    return F.coalesce(p.between(*PLAUSIBLE), F.lit(False))

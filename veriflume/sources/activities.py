"""Activity records of a protein from a bioactivity web service: target, activities, assays, release, and background sets.

Every function reads pages of one service (base is its address) through its cache; field names are those of the service.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import paged, records
from .paged import Cache, SourceError, batched_lookup, get

TARGET = "target_chembl_id string, target_type string, pref_name string"
ACTIVITY = "activity_id string, molecule_chembl_id string, canonical_smiles string, standard_type string, standard_value string, standard_units string, standard_relation string, assay_chembl_id string, assay_type string, data_validity_comment string, potential_duplicate string, pchembl_value string"
ASSAY = "assay_chembl_id string, assay_type string, confidence_score string, description string, assay_organism string"


def targets(spark: SparkSession, base: str, accession: str, cache: str | None = None, offline: bool = False) -> DataFrame:
    """(target_id, target_type, accessions) of targets with a component of that accession; the filter is part of the address."""
    found = paged.paged(spark, f"{base}/target.json?target_components__accession={accession}", TARGET, "targets", limit=50, page=50, cache=cache, offline=offline)
    return found.select(F.col("target_chembl_id").alias("target_id"), "target_type", F.array(F.lit(accession)).alias("accessions"))


def activities(spark: SparkSession, base: str, target: str, types: list[str], limit: int = 8000, cache: str | None = None, offline: bool = False, page: int = paged.PAGE) -> DataFrame:
    """A target's activities of some types that have a structure; target, types and structure are asked of the service, nothing else is filtered."""
    address = f"{base}/activity.json?target_chembl_id={target}&standard_type__in={','.join(types)}&canonical_smiles__isnull=false"
    return paged.paged(spark, address, ACTIVITY, "activities", limit=limit, page=page, cache=cache, offline=offline)


def assays(ids: DataFrame, base: str, cache: str | None = None, offline: bool = False) -> DataFrame:
    """(assay_id, assay_type, confidence_score, description, organism) of activities' assays, asked for fifty at a time."""
    found = batched_lookup(ids, "assay_chembl_id", f"{base}/assay.json", "assay_chembl_id__in", "assays", "assay_chembl_id", ASSAY, cache=cache, offline=offline)
    return found.select(F.col("assay_chembl_id").alias("assay_id"), "assay_type", F.col("confidence_score").try_cast("int").alias("confidence_score"), "description", F.col("assay_organism").alias("organism"))


def renamed(found: DataFrame, target: str) -> DataFrame:
    """Activities of the service as activity records, values still as text; seq is the service's own order of ids."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.col("pchembl_value").cast("string").try_cast("double")
    return found.select(
        text("activity_id").alias("activity_id"), F.lpad(text("activity_id"), 20, "0").alias("seq"), text("molecule_chembl_id").alias("compound_id"), text("canonical_smiles").alias("smiles"), F.lit(target).alias("target_id"), text("standard_type").alias("activity_type"),
        F.col("standard_value").alias("value"), F.col("standard_units").alias("unit"), F.col("standard_relation").alias("relation"), text("assay_chembl_id").alias("assay_id"), "assay_type", "data_validity_comment",
        F.lower(text("potential_duplicate")).isin("1", "true").alias("potential_duplicate"), number.alias("pchembl_value"), F.lit(None).cast("double").alias("molecular_weight"),
    )


def fetch_records(spark: SparkSession, base: str, accession: str, types: list[str], limit: int = 8000, cache: str | None = None, offline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(activity records ready for curation, one row of where they come from) of the single-protein target of an accession."""
    target = records.resolve_target(targets(spark, base, accession, cache, offline), accession)
    found = activities(spark, base, target, types, limit, cache, offline)
    known = assays(found.select("assay_chembl_id"), base, cache, offline)
    out = records.assemble(renamed(found, target), known)
    origin = out.agg(F.count("*").alias("n_activities"), F.count_distinct(F.when(~F.col("no_assay"), F.col("assay_id"))).alias("n_assays"), F.count_if("no_assay").alias("n_missing_assays"))
    origin = origin.select(F.lit(accession).alias("accession"), F.lit(target).alias("target_id"), F.array(*map(F.lit, types)).alias("activity_types"), "*", F.lit(release(base, cache, offline)).cast("string").alias("release"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"))
    return out.drop("no_assay"), origin


RELEASE_KEYS = ["chembl_db_version", "chembl_release"]


def release_of(payload: Column) -> Column:
    """The release that a status document (JSON) names under either key, or NULL."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in RELEASE_KEYS])


def release(base: str, cache: str | None = None, offline: bool = False) -> str | None:
    try:
        payload = get(f"{base}/status.json", Cache(cache), offline)
    except SourceError:
        return None
    return next((payload[k] for k in RELEASE_KEYS if payload.get(k)), None)


def scan_background(spark: SparkSession, base: str, accessions: dict[str, str], per_source: int = 200, types: list[str] = ("IC50", "Ki"), cache: str | None = None, offline: bool = False, page: int = paged.PAGE, parallel: int = 1) -> tuple[DataFrame, DataFrame]:
    """((source, molecule_id, smiles, seq), (source, reason)) of named accessions: the first distinct molecules of each, and what failed.

    One scan, a partition for each reader: a target that cannot be read is a row with its reason, and costs itself only. Four activities a
    molecule wanted are asked for. Readers share one interval between requests; a retried task finds its responses in the cache.
    """
    from ..operators.background import contributions

    limit = per_source * 4
    wanted = spark.createDataFrame([(i % parallel, n, a) for i, (n, a) in enumerate(accessions.items())], "reader int, source string, accession string")

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, paces = Cache(cache), {}
        for pdf in parts:
            for reader, name, accession in zip(pdf["reader"], pdf["source"], pdf["accession"]):
                pace = paces.setdefault(reader, paged.Pace(int(reader), parallel))
                rows, reason = [], None
                try:
                    target = _single(get(f"{base}/target.json?target_components__accession={accession}&limit=50&offset=0", held, offline, pace=pace), accession)
                    address = f"{base}/activity.json?target_chembl_id={target}&standard_type__in={','.join(types)}&canonical_smiles__isnull=false"
                    for offset, size in paged.pages(limit, limit, page):
                        found = get(f"{address}&limit={size}&offset={offset}", held, offline, pace=pace).get("activities", [])
                        rows += [(name, x.get("molecule_chembl_id"), x.get("canonical_smiles"), offset + k, None) for k, x in enumerate(found)]
                        if len(found) < size:  # a short page is the last
                            break
                except Exception as problem:  # noqa: BLE001  whatever the service or its answers have, the other targets go on
                    rows, reason = [], str(problem).split("\n")[0][:120]
                yield pd.DataFrame(rows if reason is None else [(name, None, None, None, reason)], columns=["source", "molecule_id", "smiles", "seq", "reason"], dtype=object)

    found = cut(wanted.repartition(parallel, "reader").mapInPandas(scan, "source string, molecule_id string, smiles string, seq long, reason string"))
    failed = found.where("reason IS NOT NULL").select("source", "reason")
    names = [n for n in accessions if n not in {r["source"] for r in failed.collect()}]  # a row a failed target
    kept, empty = contributions(found.where("reason IS NULL").drop("reason"), per_source, names)
    return kept, empty.unionByName(failed)


def _single(payload: dict, accession: str) -> str:
    """The one single-protein target of an answer."""
    ids = {t.get("target_chembl_id") for t in payload.get("targets", []) if t.get("target_type") == "SINGLE PROTEIN"}
    if len(ids) != 1:
        raise records.TargetError(f"{len(ids) or 'no'} single-protein target{'s' * (len(ids) != 1)} for {accession}")
    return ids.pop()

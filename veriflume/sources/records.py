"""Assembling activity records from their parts, and reading and writing tables and reports."""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paged import Cache, Pace, SourceError, get
from .sinks import write_cell


class TargetError(ValueError):
    pass


def resolve_target(targets: DataFrame, accession: str) -> str:
    """The one single-protein target that has the accession."""
    got = targets.where(F.array_contains("accessions", accession) & (F.col("target_type") == "SINGLE PROTEIN")).select("target_id").distinct().take(2)
    if len(got) != 1:
        raise TargetError(f"{len(got) or 'no'} single-protein target{'s' * (len(got) != 1)} for {accession}")
    return got[0][0]


def assemble(activities: DataFrame, assays: DataFrame) -> DataFrame:
    """activities (value as text) with their assay's type and confidence, and no_assay; values that are not numbers become NULL.

    Of several records of an assay the largest counts, so the result does not depend on their order. Assays are joined by an
    equi-join; adaptive execution broadcasts them where they are few.
    """
    assay = assays.groupBy("assay_id").agg(F.max(F.struct(F.col("assay_type").alias("t"), F.col("confidence_score").alias("c"))).alias("__a"))
    value = F.col("value").cast("string").try_cast("double")
    out = activities.drop("confidence_score").join(assay, "assay_id", "left").withColumn("no_assay", F.col("__a").isNull())
    out = out.withColumns({"__v": value, "confidence_score": F.col("__a.c")})
    finite = ~F.isnan("__v") & (F.abs("__v") < float("inf"))
    return out.withColumn("value", F.when(finite, F.col("__v"))).withColumn("relation", F.when(F.coalesce("relation", F.lit("")) == "", "=").otherwise(F.col("relation"))).withColumn("assay_type", F.coalesce(F.when(F.col("__a.t") != "", F.col("__a.t")), "assay_type")).drop("__a", "__v")

def missing_metadata(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("confidence_score").isNull()).alias("no_confidence"), F.count_if(F.col("assay_type").isNull()).alias("no_assay_type"), F.count_if(F.col("value").isNull()).alias("no_value"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard file, in the order of file names."""
    return spark.read.json(path, multiLine=True).withColumn("file", F.input_file_name()).orderBy("file")


def shard_candidates(shards: DataFrame) -> DataFrame:
    return shards.select("shard", F.explode("candidates").alias("c")).select("shard", "c.*")


def flatten_records(records: DataFrame) -> DataFrame:
    """The columns of activity records that a reader looks at, in their order, for CSV."""
    return records.select("activity_id", "compound_id", "target_id", "activity_type", "value", "unit", "relation", "assay_type", "confidence_score", "data_validity_comment", "pchembl_value", "smiles")


def flatten_rejections(rejections: DataFrame) -> DataFrame:
    return rejections.select("activity_id", "compound_id", "target_id", "rule", "detail")


def labelled_points(points: DataFrame) -> DataFrame:
    """Curated points as output rows: the value's label and origin, spread only of several measurements, lists as text."""
    from ..functions import quantity as Q

    q = Q.quantity(F.col("pactivity"), "derived", None, F.array_join("source_activity_ids", "; "), F.col("uncertainty"))
    spread = F.when(F.col("n_measurements") > 1, F.col("spread"))
    return points.select("compound_id", "smiles", "target_id", "pactivity", Q.label(q).alias("pactivity_label"), F.lit("derived").alias("origin"), "n_measurements", spread.alias("spread_log_units"), F.array_join("activity_types", ",").alias("activity_types"), F.array_join("source_activity_ids", ",").alias("source_activity_ids"))


def flatten_points(points: DataFrame) -> DataFrame:
    """Curated points with arrays as text, for CSV."""
    return points.withColumn("source_activity_ids", F.array_join("source_activity_ids", ";")).withColumn("activity_types", F.array_join("activity_types", ";"))


def write_csv(df: DataFrame, path: str) -> bool:
    """Writes nothing, and says so, when there is nothing."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True)
    return True


def report_rows(triaged: DataFrame, limit: int = 50) -> tuple[str, DataFrame]:
    """(key, rows) of a report: a shortlist, the most efficient first, or unranked candidates where the triage was withheld; a top-k report."""
    withheld = bool(triaged.agg(F.bool_or("withheld")).first()[0])
    rows = triaged.where("kept")
    rows = rows if withheld else rows.orderBy("ligand_efficiency", "seq") if "seq" in rows.columns else rows.orderBy("ligand_efficiency")
    return ("candidates_unranked" if withheld else "shortlist"), rows.limit(limit)


def write_report(triaged: DataFrame, path: str, limit: int = 50, **summary) -> str:
    """One JSON document: summary fields, whether the triage was withheld, and the list under the key that says what it is; returns the key."""
    key, rows = report_rows(triaged, limit)
    n = triaged.agg(F.count("*").alias("n_candidates"), F.count_if("kept").alias("n_kept"), F.coalesce(F.bool_or("withheld"), F.lit(False)).alias("triage_withheld"))
    listed = rows.agg(F.collect_list(F.struct(*rows.columns)).alias(key))  # at most `limit` rows
    out = n.crossJoin(listed)  # 1 x 1 rows
    fields = [F.lit(v).alias(k) for k, v in summary.items()]
    out.select(F.to_json(F.struct(*fields, *out.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return key


def read_selection(spark: SparkSession, path: str, field: str = "selected") -> DataFrame:
    """One row for each structure of a selection document (JSON)."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("s")).select("s.*")


def component_smiles(sdf: Column, descriptors: Column, path: str = "$.smiles") -> Column:
    """A ligand's structure: from its structure file where that can be read, else from its descriptor document; NULL of neither, with the source."""
    from ..functions import molecules

    own = F.pandas_udf(lambda s: s.map(molecules.from_molfile), "string")(sdf)
    other = F.get_json_object(descriptors, path)
    return F.struct(F.coalesce(own, other).alias("smiles"), F.when(own.isNotNull(), "structure file").when(other.isNotNull(), "descriptor").otherwise("none").alias("source"))

def search(catalogue: DataFrame, accession: str, method: str, max_resolution: float, limit: int) -> DataFrame:
    """The `limit` best-resolved structures of an accession by one method (three AND-ed terms; a top-k query)."""
    hit = F.array_contains("accessions", accession) & (F.col("method") == method) & (F.col("resolution") <= max_resolution)
    return catalogue.where(hit).orderBy("resolution", "structure_id").limit(limit)


# Attributes of the structure search service.
SEARCHED = {"accession": "rcsb_polymer_entity_container_identifiers.reference_sequence_identifiers.database_accession", "database": "rcsb_polymer_entity_container_identifiers.reference_sequence_identifiers.database_name", "resolution": "rcsb_entry_info.resolution_combined"}


def search_terms(accession: str, max_resolution: float, limit: int) -> dict:
    """The search document of an accession's structures up to a resolution: three AND-ed terms, the best resolved first, so many of them."""
    wanted = [("accession", "exact_match", accession), ("database", "exact_match", "UniProt"), ("resolution", "less_or_equal", max_resolution)]
    nodes = [{"type": "terminal", "service": "text", "parameters": dict(zip(("attribute", "operator", "value"), (SEARCHED[k], how, v)))} for k, how, v in wanted]
    order = {"sort_by": SEARCHED["resolution"], "direction": "asc"}
    return {"query": {"type": "group", "logical_operator": "and", "nodes": nodes}, "return_type": "entry", "request_options": {"paginate": {"start": 0, "rows": limit}, "sort": [order]}}


def search_service(spark: SparkSession, address: str, accessions: list[str], max_resolution: float, limit: int, cache: str | None = None, offline: bool = False, parallel: int = 1) -> DataFrame:
    """(accession, rank, structure_id, reason): what the service answers for each accession, in its order; one that fails is a row with its reason.

    Requests are GETs with the document in `json`, so that they have an address in the cache; readers share one interval.
    """
    wanted = spark.createDataFrame([(i % parallel, a) for i, a in enumerate(accessions)], "reader int, accession string")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, paces = Cache(cache), {}
        for pdf in parts:
            for reader, accession in zip(pdf["reader"], pdf["accession"]):
                pace = paces.setdefault(reader, Pace(int(reader), parallel))
                terms = json.dumps(search_terms(accession, max_resolution, limit), sort_keys=True, separators=(",", ":"))
                try:
                    hits = get(f"{address}?{urllib.parse.urlencode({'json': terms})}", held, offline, pace=pace).get("result_set") or []
                    rows = [(accession, k, h["identifier"], None) for k, h in enumerate(hits[:limit])]
                except (SourceError, KeyError, TypeError) as problem:
                    rows = [(accession, None, None, str(problem).split("\n")[0][:120])]
                yield pd.DataFrame(rows, columns=["accession", "rank", "structure_id", "reason"], dtype=object)

    return wanted.repartition(parallel, "reader").mapInPandas(ask, "accession string, rank int, structure_id string, reason string")


def flush(cell: DataFrame, path: str, name: str) -> None:
    """Writes one finished cell, so that a crash costs one; a cell that is written again replaces itself. See sinks."""
    write_cell(cell, path, name)

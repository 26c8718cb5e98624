"""Queries on what surrounds a campaign: refusals, arms, structure surveys, cells, quantities at the edge, pose text, chosen structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantity as Q
from ..operators import generation, guards, screening
from .bridge import FINGERPRINT_CTE, fingerprints, table
from .curation import ORIGIN, _quantities
from .registry import query


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def guarded_groups(spark, d):
    """Groups of a table that is large enough to work on; one that is not is refused before any work."""
    events = guards.require_groups(guards.require_rows(table(spark, d, "events"), "records"), "event_type")
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS receptor, n_nationkey AS ligand, s_suppkey = n_nationkey OR (s_suppkey + n_nationkey) % 3 = 0 AS allowed FROM supplier, nation")
def cross_docking_pairs(spark, d):
    receptors, ligands = table(spark, d, "supplier").select(F.col("s_suppkey").alias("structure_id")), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("structure_id"))
    known = receptors.select(F.col("structure_id").alias("receptor"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("ligand"))
    return guards.cross_pairs(receptors, ligands, known.withColumn("trusted", (F.col("receptor") + F.col("ligand")) % 3 == 0))


ARM = "SELECT count(DISTINCT o_orderpriority) AS priorities, min(o_orderpriority) AS first_priority, count(*) AS n, max(o_custkey % 2) AS odd FROM orders WHERE o_orderstatus = '{}'"
SETTINGS = ["priorities", "first_priority", "n", "odd"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS setting FROM ({ARM.format('F')}) a, ({ARM.format('O')}) b WHERE a.{c} IS DISTINCT FROM b.{c}" for c in SETTINGS))
def arm_settings(spark, d):
    """The settings in which two arms differ, field by field."""
    orders = table(spark, d, "orders")
    arm = lambda s: orders.where(F.col("o_orderstatus") == s).agg(F.count_distinct("o_orderpriority").alias("priorities"), F.min("o_orderpriority").alias("first_priority"), F.count("*").alias("n"), F.max(F.col("o_custkey") % 2).alias("odd"))
    return spark.createDataFrame([(c,) for c in guards.differing(arm("F"), arm("O"), SETTINGS)], "setting string")


SURVEY = "lig AS (SELECT p_size AS structure_id, p_type AS chain FROM part WHERE p_partkey % 9 = 0), pep AS (SELECT DISTINCT p_size AS structure_id, p_type AS chain FROM part WHERE p_partkey % 2 = 0)"


@query(f"WITH {SURVEY}, l AS (SELECT lig.structure_id, count(*) AS n, count(pep.chain) AS k FROM lig LEFT JOIN pep USING (structure_id, chain) GROUP BY 1) SELECT s.structure_id, CASE WHEN n IS NULL THEN 'no ligand' WHEN n = k THEN 'fragment' ELSE 'usable' END AS state FROM (SELECT DISTINCT p_size AS structure_id FROM part) s LEFT JOIN l USING (structure_id)")
def structure_survey(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("structure_id"), F.col("p_type").alias("chain"), "p_partkey")
    peptides = p.where("p_partkey % 2 = 0").select("structure_id", "chain").distinct().withColumn("is_peptide", F.lit(True))
    return guards.usable_structures(p, p.where("p_partkey % 9 = 0").select("structure_id", "chain"), peptides)


POSES = "SELECT l_suppkey % 10 AS receptor, l_partkey % 20 AS ligand, l_orderkey * 10000 + l_linenumber * 1000 + l_partkey % 1000 AS rank, l_extendedprice / 20000.0::DOUBLE + l_quantity / 10.0::DOUBLE AS rmsd FROM lineitem"


@query(f"WITH p AS (SELECT receptor, ligand, rank, min(rmsd) AS rmsd FROM ({POSES}) GROUP BY ALL) SELECT receptor, ligand, round(arg_min(rmsd, rank), 9) AS top_rmsd, round(min(rmsd), 9) AS best_rmsd, min(rmsd) < 2 AS within FROM p GROUP BY ALL")
def docking_cells(spark, d):
    li = table(spark, d, "lineitem")
    rank = F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000
    p = li.select((F.col("l_suppkey") % 10).alias("receptor"), (F.col("l_partkey") % 20).alias("ligand"), rank.alias("rank"), (F.col("l_extendedprice") / 20000.0 + F.col("l_quantity") / 10.0).alias("rmsd"))
    out = guards.cell_summary(p.groupBy("receptor", "ligand", "rank").agg(F.min("rmsd").alias("rmsd")))
    return out.select("receptor", "ligand", F.round("top_rmsd", 9).alias("top_rmsd"), F.round("best_rmsd", 9).alias("best_rmsd"), "within")


@query(f"SELECT a, count(*) AS n, round(sum(CASE WHEN l_quantity > 5 THEN l_extendedprice END), 2) AS required, round(sum(CASE WHEN l_quantity > 5 THEN l_extendedprice ELSE -1 END), 2) AS defaulted, 2 AS n_notes FROM (SELECT *, {ORIGIN} AS a FROM lineitem) GROUP BY a")
def quantity_edge(spark, d):
    """What is required (a missing one would raise), defaulted, and said of quantities."""
    q, noted = F.col("q"), Q.with_notes(F.col("q"), "seen", "kept")
    rows = _quantities(spark, d)
    known = rows.where(Q.is_known(q)).groupBy("a").agg(F.round(F.sum(Q.require(q)), 2).alias("required"))
    rest = rows.groupBy("a").agg(F.count("*").alias("n"), F.round(F.sum(Q.or_else(q, F.lit(-1.0))), 2).alias("defaulted"), F.max(F.size(noted["notes"])).alias("n_notes"))
    return rest.join(known, "a")


@query(f"SELECT a, count(*) AS n, count(*) AS n_same, count(*) FILTER (WHERE l_quantity > 5) AS n_known FROM (SELECT *, {ORIGIN} AS a FROM lineitem) GROUP BY a")
def quantity_json(spark, d):
    """Quantities that come back from JSON as they went."""
    q = F.col("q")
    back = Q.from_json(Q.to_json(q))
    return _quantities(spark, d).groupBy("a").agg(F.count("*").alias("n"), F.count_if(back.eqNullSafe(q)).alias("n_same"), F.count(back["value"]).alias("n_known"))


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type <> 'view' AND value IS NOT NULL")
def ranked_candidates(spark, d):
    """Only what may be ranked has a rank."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("prediction"), ((F.col("event_type") != "view") & F.col("value").isNotNull()).alias("rankable"))
    return generation.ranked(e).select(F.col("seq").alias("event_id"), "rank")


PICKED = "(15 + id % 30 BETWEEN 20 AND 40 AND 1 + (id % 20) / 10.0::DOUBLE <= 2 OR id = 7)"


@query(f"WITH RECURSIVE {FINGERPRINT_CTE}, o AS (SELECT *, row_number() OVER (ORDER BY id <> 7, id) AS k FROM fpb WHERE {PICKED}), step(k, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, word BIGINT, bits BIGINT)[] UNION ALL SELECT o.k, CASE WHEN len(list_filter(kept, lambda x: bit_count(x.word & o.word) / nullif(x.bits + o.bits - bit_count(x.word & o.word), 0)::DOUBLE >= 0.45)) > 0 THEN kept ELSE list_append(kept, {{'id': o.id, 'word': o.word, 'bits': o.bits}}) END FROM step JOIN o ON o.k = step.k + 1) SELECT unnest(kept).id AS id FROM step WHERE k = (SELECT max(k) FROM o)")
def structure_set(spark, d):
    """Structures within bounds of size and resolution, greedily unlike each other, with one that is in whatever its bounds."""
    f = fingerprints(spark, d).withColumns({"heavy_atoms": 15 + F.col("id") % 30, "resolution": 1 + (F.col("id") % 20) / F.lit(10.0)})
    return generation.select_diverse(f, pinned=7)


@query("SELECT label, count(*) AS n_models, round(avg(round(embedding[1]::DOUBLE * 30, 3)), 6) AS x, round(avg(round(embedding[3]::DOUBLE * 30, 3)), 6) AS z FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY 1")
def pose_text(spark, d):
    """Heavy-atom coordinates read from pose text: a model for every vector, with a hydrogen that does not count."""
    e = table(spark, d, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")
    at = lambda i: F.lpad(F.format_string("%.3f", F.round(F.col("embedding")[i].cast("double") * 30, 3)), 8, " ")
    line = lambda element: F.concat(F.lit("ATOM      1  C   LIG A   1    "), at(0), at(1), at(2), F.lit("  1.00  0.00"), F.lit(" " * 11), F.lit(element))
    text = F.concat(F.lit("MODEL 1\n"), line("C "), F.lit("\n"), line("HD"), F.lit("\nENDMDL\n"))
    models = e.select("label", F.explode(screening.poses(text)).alias("m"))
    atoms = models.select("label", F.size("m").alias("k"), F.explode("m").alias("a")).where("k = 1")
    return atoms.groupBy("label").agg(F.count("*").alias("n_models"), F.round(F.avg("a.x"), 6).alias("x"), F.round(F.avg("a.z"), 6).alias("z"))

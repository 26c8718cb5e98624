"""Queries on units, provenance, curation, backgrounds and triage accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantity as Q
from ..functions import units
from ..operators import background, curate, guards, similarity
from ..session import cut
from ..sources import paged, records
from .bridge import ACTIVITY_CTE, activity, table
from .registry import query

NORM = "replace(replace(replace(replace(replace(replace(lower(regexp_replace(coalesce(unit, ''), '^\\s+|\\s+$', '', 'g')), 'µ', 'u'), 'μ', 'u'), ' ', ''), '/l', '.l-1'), '/ml', '.ml-1'), '/kg', '.kg-1')"
FACTOR = "CASE norm WHEN 'm' THEN 1.0 WHEN 'mm' THEN 1e-3 WHEN 'um' THEN 1e-6 WHEN 'nm' THEN 1e-9 WHEN 'pm' THEN 1e-12 WHEN 'fm' THEN 1e-15 END"
MASS = "CASE norm WHEN 'g.l-1' THEN 1.0 WHEN 'mg.l-1' THEN 1e-3 WHEN 'ug.l-1' THEN 1e-6 WHEN 'ng.l-1' THEN 1e-9 WHEN 'g.ml-1' THEN 1000.0 WHEN 'mg.ml-1' THEN 1.0 WHEN 'ug.ml-1' THEN 1e-3 WHEN 'ng.ml-1' THEN 1e-6 END"
FAMILY = "CASE WHEN activity_type IN ('IC50', 'EC50', 'XC50', 'AC50', 'pIC50', 'pEC50') THEN 'functional' WHEN activity_type IN ('Ki', 'Kd', 'KD', 'pKi', 'pKd') THEN 'binding' END"
RULED = f"""{ACTIVITY_CTE},
n AS (SELECT *, {NORM} AS norm FROM activity),
m AS (SELECT *, coalesce(value * ({FACTOR})::DOUBLE, CASE WHEN molecular_weight > 0 THEN value * ({MASS})::DOUBLE / molecular_weight END) AS molar, ({MASS}) IS NOT NULL AS massive, {FAMILY} AS family FROM n),
c AS (SELECT *, CASE WHEN value IS NULL THEN 'no value' WHEN relation NOT IN ('=', '==') THEN 'censored' WHEN norm = '%' THEN 'not a concentration'
      WHEN massive AND (molecular_weight IS NULL OR molecular_weight <= 0) THEN 'needs molecular weight' WHEN molar IS NULL THEN 'unrecognised unit' WHEN molar <= 0 THEN 'non-positive' END AS reason FROM m),
v AS (SELECT *, CASE WHEN reason IS NULL THEN -log10(molar) END AS p FROM c),
ruled AS (SELECT *, CASE WHEN smiles IS NULL OR smiles = '' THEN 'missing_structure' WHEN confidence_score IS NULL OR confidence_score < 8 THEN 'low_target_confidence' WHEN assay_type NOT IN ('B', 'F') THEN 'wrong_assay_type'
      WHEN family IS NULL OR family <> 'functional' THEN 'incommensurable_endpoint' WHEN data_validity_comment IS NOT NULL THEN 'source_flagged_invalid' WHEN potential_duplicate THEN 'potential_duplicate'
      WHEN relation NOT IN ('=', '==') THEN 'censored_measurement' WHEN p IS NULL THEN 'unconvertible_value' WHEN NOT p BETWEEN 2 AND 12 THEN 'implausible_pactivity' WHEN abs(p - pchembl_value) > 0.1 THEN 'pchembl_disagreement' END AS rule FROM v),
grp AS (SELECT compound_id, target_id, count(*) AS n_measurements, max(p) - min(p) AS spread, median(p) AS med, avg(p) AS mean, arg_min(smiles, seq) AS smiles, string_agg(activity_id, ';' ORDER BY seq) AS ids, string_agg(DISTINCT activity_type, ';' ORDER BY activity_type) AS types FROM ruled WHERE rule IS NULL GROUP BY ALL)"""


@query(f"WITH {ACTIVITY_CTE} SELECT unit, {NORM} AS norm, count(*) AS n FROM activity GROUP BY ALL")
def unit_normalise(spark, d):
    return activity(spark, d).groupBy("unit", units.normalise_unit(F.col("unit")).alias("norm")).agg(F.count("*").alias("n"))


@query(f"WITH {RULED} SELECT seq, round(p, 9) AS pactivity FROM ruled")
def pactivity_value(spark, d):
    return units.converted(activity(spark, d)).select("seq", F.round("pactivity", 9).alias("pactivity"))


@query(f"WITH {RULED} SELECT coalesce(reason, 'converted') AS reason, count(*) AS n, count(*) FILTER (WHERE p BETWEEN 2 AND 12) AS n_plausible FROM ruled GROUP BY 1")
def pactivity_reason(spark, d):
    return units.converted(activity(spark, d)).groupBy(F.coalesce("reason", F.lit("converted")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(units.is_plausible(F.col("pactivity"))).alias("n_plausible"))


QUOTED = "chr(39) || unit || chr(39)"
REFUSAL = f"CASE reason WHEN 'no value' THEN 'no value is given' WHEN 'censored' THEN 'relation ' || chr(39) || relation || chr(39) || ' gives an upper bound only' WHEN 'not a concentration' THEN 'unit ' || {QUOTED} || ' is no concentration' WHEN 'needs molecular weight' THEN 'unit ' || {QUOTED} || ' cannot be made molar without a molecular weight' WHEN 'unrecognised unit' THEN 'unit ' || {QUOTED} || ' is not known' END"
CITATION = "activity_id || ' / assay ' || assay_id || ' / target ' || target_id"


@query(f"WITH {RULED} SELECT {REFUSAL} AS what, 'derived' AS origin, count(*) AS n FROM ruled WHERE reason IS NOT NULL GROUP BY ALL")
def refused_quantities(spark, d):
    """What unknown pActivities say of themselves, after the citation."""
    df = units.converted(activity(spark, d), keep_steps=True)
    q = units.as_quantity(units.citation(F.col("activity_id"), F.col("assay_id"), F.col("target_id")))
    df = df.select(q.alias("q")).where("q.value IS NULL")
    return df.groupBy(F.split("q.source", ": ")[1].alias("what"), F.col("q.origin").alias("origin")).agg(F.count("*").alias("n"))


@query(f"WITH {ACTIVITY_CTE} SELECT {CITATION} AS citation, count(*) AS n FROM activity GROUP BY 1")
def citations(spark, d):
    c = units.citation(F.col("activity_id"), F.col("assay_id"), F.col("target_id"))
    return activity(spark, d).groupBy(c.alias("citation")).agg(F.count("*").alias("n"))


@query(f"WITH {ACTIVITY_CTE} SELECT count(*) AS n, count(*) FILTER (WHERE unit IN ('nM', 'uM')) AS n_molar, count(*) FILTER (WHERE unit = 'ug.mL-1' AND molecular_weight > 0 AND value IS NOT NULL) AS n_by_weight FROM activity")
def unit_kinds(spark, d):
    mass = units.mass_per_litre_to_molar(F.col("value"), F.col("unit"), F.col("molecular_weight"))
    return activity(spark, d).agg(F.count("*").alias("n"), F.count_if(units.is_concentration_unit(F.col("unit"))).alias("n_molar"), F.count(mass).alias("n_by_weight"))


@query(f"WITH {RULED} SELECT coalesce(family, 'none') AS family, activity_type, count(*) AS n FROM ruled GROUP BY ALL")
def activity_family(spark, d):
    return activity(spark, d).groupBy(F.coalesce(units.family_of(F.col("activity_type")), F.lit("none")).alias("family"), "activity_type").agg(F.count("*").alias("n"))


@query(f"WITH {RULED} SELECT seq, coalesce(rule, 'kept') AS rule FROM ruled")
def curate_rules(spark, d):
    return curate.apply_rules(activity(spark, d)).select("seq", F.coalesce("rule", F.lit("kept")).alias("rule"))


POINTS = "SELECT target_id, compound_id, smiles, n_measurements, round({stat}, 9) AS pactivity, round(spread, 9) AS spread, round(CASE WHEN n_measurements > 1 THEN spread / 2 END, 9) AS uncertainty, ids AS source_activity_ids, types AS activity_types FROM grp WHERE spread <= 1"


def _points(df):
    return records.flatten_points(df).select("target_id", "compound_id", "smiles", "n_measurements", *[F.round(c, 9).alias(c) for c in ("pactivity", "spread", "uncertainty")], "source_activity_ids", "activity_types")


@query(f"WITH {RULED} " + POINTS.format(stat="med"))
def curate_points(spark, d):
    return _points(curate.curate(activity(spark, d))[0])


@query(f"WITH {RULED} " + POINTS.format(stat="mean"))
def curate_points_mean(spark, d):
    return _points(curate.curate(activity(spark, d), aggregation=curate.AggregationPolicy(statistic="mean"))[0])


@query(f"WITH {RULED} SELECT seq, activity_id, rule FROM ruled WHERE rule IS NOT NULL UNION ALL SELECT r.seq, r.activity_id, 'irreconcilable_replicates' FROM ruled r JOIN grp g USING (compound_id, target_id) WHERE r.rule IS NULL AND g.spread > 1")
def curate_rejections(spark, d):
    return curate.curate(activity(spark, d))[1].select("seq", "activity_id", "rule")


@query(f"WITH {RULED}, x AS (SELECT (SELECT count(*) FROM ruled) AS n_input, (SELECT count(*) FROM grp WHERE spread <= 1) AS n_points, (SELECT sum(n_measurements)::BIGINT FROM grp WHERE spread <= 1) AS n_kept_measurements, (SELECT count(*) FROM ruled WHERE rule IS NOT NULL) + (SELECT coalesce(sum(n_measurements), 0)::BIGINT FROM grp WHERE spread > 1) AS n_rejected) SELECT n_input, n_points, n_kept_measurements, n_rejected, round((n_input - n_rejected) / n_input::DOUBLE, 9) AS retention, n_kept_measurements + n_rejected = n_input AS balanced FROM x")
def curate_accounting(spark, d):
    return curate.accounting(activity(spark, d)).withColumn("retention", F.round("retention", 9))


@query(f"WITH {RULED} SELECT CASE WHEN smiles IS NULL OR smiles = '' THEN 'missing_structure' WHEN relation NOT IN ('=', '==') THEN 'censored_measurement' WHEN p IS NULL THEN 'unconvertible_value' WHEN NOT p BETWEEN 2 AND 12 THEN 'implausible_pactivity' ELSE 'kept' END AS rule, count(*) AS n FROM ruled GROUP BY 1")
def curate_permissive(spark, d):
    return curate.apply_rules(activity(spark, d), curate.PERMISSIVE).groupBy(F.coalesce("rule", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))


@query(f"WITH {RULED}, r AS (SELECT rule FROM ruled WHERE rule IS NOT NULL UNION ALL SELECT 'irreconcilable_replicates' FROM ruled r JOIN grp g USING (compound_id, target_id) WHERE r.rule IS NULL AND g.spread > 1) SELECT rule, count(*) AS n FROM r GROUP BY 1")
def rejection_summary(spark, d):
    return curate.summary(curate.curate(activity(spark, d))[1])


DETAIL = f"CASE rule WHEN 'missing_structure' THEN 'no structure is given' WHEN 'low_target_confidence' THEN CASE WHEN confidence_score IS NULL THEN 'no confidence score' ELSE 'confidence ' || confidence_score || ' is under 8' END WHEN 'wrong_assay_type' THEN 'assay type ' || chr(39) || assay_type || chr(39) || ' is none of B, F' WHEN 'incommensurable_endpoint' THEN 'family ' || chr(39) || family || chr(39) || ' is none of functional' WHEN 'source_flagged_invalid' THEN 'the source says ' || chr(39) || data_validity_comment || chr(39) WHEN 'potential_duplicate' THEN 'the source takes it for a repeated measurement' WHEN 'censored_measurement' THEN 'relation ' || chr(39) || relation || chr(39) || ' is a bound, not a value' WHEN 'unconvertible_value' THEN {REFUSAL} WHEN 'implausible_pactivity' THEN printf('pActivity %.2f is not within 2.0 to 12.0', p) WHEN 'pchembl_disagreement' THEN printf('pActivity %.2f, but %.2f by the source', p, pchembl_value) END"


APART = "printf('%d measurements lie %.2f log units apart, over 1.0', n_measurements, spread)"


@query(f"WITH {RULED}, d AS (SELECT rule, {DETAIL} AS detail FROM ruled WHERE rule IS NOT NULL UNION ALL SELECT 'irreconcilable_replicates', {APART} FROM ruled r JOIN grp g USING (compound_id, target_id) WHERE r.rule IS NULL AND g.spread > 1) SELECT rule, detail, count(*) AS n FROM d GROUP BY ALL")
def rejection_details(spark, d):
    """Every rejected record's rule in words."""
    return curate.curate(activity(spark, d))[1].groupBy("rule", "detail").agg(F.count("*").alias("n"))


@query(f"WITH {RULED}, pts AS (SELECT target_id, compound_id, med FROM grp WHERE spread <= 1) SELECT count(*) FILTER (WHERE med >= 8) AS n_active, count(*) FILTER (WHERE med <= 5.5) AS n_decoy_pool, count(*) FILTER (WHERE med <= 6) AS n_background FROM pts")
def potency_cuts(spark, d):
    points = curate.curate(activity(spark, d))[0]
    points = cut(points.select("pactivity"))
    n = [curate.potency(points, *b).agg(F.count("*").alias(name)) for name, b in (("n_active", (curate.ACTIVE_FROM,)), ("n_decoy_pool", (None, curate.DECOY_TO)), ("n_background", (None, curate.BACKGROUND_TO)))]
    return n[0].crossJoin(n[1]).crossJoin(n[2])  # one row each


@query(f"WITH {RULED} SELECT compound_id, target_id, round(med, 9) AS pactivity FROM grp WHERE spread <= 1 ORDER BY round(med, 9) DESC, compound_id, target_id LIMIT 30")
def most_potent(spark, d):
    points = curate.curate(activity(spark, d))[0].withColumn("pactivity", F.round("pactivity", 9))
    return curate.most_potent(points, 30, "compound_id", "target_id").select("compound_id", "target_id", "pactivity")


@query(f"WITH {RULED} SELECT compound_id, target_id, replace(types, ';', ',') AS activity_types, CASE WHEN n_measurements > 1 THEN round(spread, 6) END AS spread_log_units, replace(ids, ';', ',') AS source_activity_ids, 'derived' AS origin FROM grp WHERE spread <= 1")
def point_rows(spark, d):
    rows = records.labelled_points(curate.curate(activity(spark, d))[0])
    return rows.select("compound_id", "target_id", "activity_types", F.round("spread_log_units", 6).alias("spread_log_units"), "source_activity_ids", "origin")


@query(f"WITH {RULED} SELECT smiles, target_id, count(*) AS n FROM (SELECT smiles, target_id, max(p) - min(p) AS s FROM ruled WHERE rule IS NULL GROUP BY ALL) WHERE s <= 1 GROUP BY ALL")
def curate_by_structure(spark, d):
    """Replicates pooled by a key that is an expression, as a structure hash would be."""
    points = curate.curate(activity(spark, d), key=F.concat(F.lit("structure "), F.col("smiles")))[0]
    return points.groupBy("smiles", "target_id").agg(F.count("*").alias("n"))



ORIGIN = "CASE WHEN l_linenumber = 1 THEN 'measured' WHEN l_linenumber <= 3 THEN 'derived' WHEN l_linenumber <= 6 THEN 'predicted' ELSE 'heuristic' END"
ORIGIN2 = "CASE WHEN l_suppkey % 3 = 0 THEN 'measured' WHEN l_suppkey % 3 = 1 THEN 'predicted' ELSE 'derived' END"


def _quantities(spark, d):
    li = table(spark, d, "lineitem")
    a, b = F.expr(ORIGIN), F.expr(ORIGIN2)
    return li.select(a.alias("a"), b.alias("b"), Q.quantity(F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")), a, F.lit("nM"), F.lit("row"), None, F.when(a == "predicted", F.col("l_quantity") > 25)).alias("q"))


@query(f"SELECT a, b, CASE WHEN 'heuristic' IN (a, b) THEN 'heuristic' WHEN 'predicted' IN (a, b) THEN 'predicted' WHEN 'derived' IN (a, b) THEN 'derived' ELSE 'measured' END AS weakest, count(*) AS n FROM (SELECT {ORIGIN} AS a, {ORIGIN2} AS b FROM lineitem) GROUP BY ALL")
def quantity_weakest(spark, d):
    return _quantities(spark, d).groupBy("a", "b", Q.weakest(F.col("a"), F.col("b")).alias("weakest")).agg(F.count("*").alias("n"))


@query(f"SELECT a, count(*) AS n, count(*) FILTER (WHERE l_quantity > 5) AS n_known, count(*) FILTER (WHERE l_quantity > 5 AND (a IN ('measured', 'derived') OR a = 'predicted' AND l_quantity > 25)) AS n_rankable FROM (SELECT *, {ORIGIN} AS a FROM lineitem) GROUP BY a")
def quantity_rankable(spark, d):
    return _quantities(spark, d).groupBy("a").agg(F.count("*").alias("n"), F.count_if(Q.is_known(F.col("q"))).alias("n_known"), F.count_if(Q.is_rankable(F.col("q"))).alias("n_rankable"))


@query(f"SELECT o AS origin, count(*) AS n, count(v) AS n_known, round(sum(v), 2) AS total FROM (SELECT CASE WHEN l_quantity > 5 THEN l_extendedprice * 2 END AS v, CASE WHEN a = 'measured' THEN 'derived' ELSE a END AS o FROM (SELECT *, {ORIGIN} AS a FROM lineitem)) GROUP BY 1")
def quantity_map(spark, d):
    q = Q.map_value(F.col("q"), F.col("q.value") * 2, "derived", F.lit("twice"))
    return _quantities(spark, d).select(q.alias("m")).groupBy(F.col("m.origin").alias("origin")).agg(F.count("*").alias("n"), F.count("m.value").alias("n_known"), F.round(F.sum("m.value"), 2).alias("total"))


@query(f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 5 THEN printf('%.3f', l_extendedprice) || ' nM [' || a || CASE WHEN a = 'predicted' AND l_quantity <= 25 THEN ', OUT OF DOMAIN' ELSE '' END || ']' ELSE 'not computed' END AS label FROM (SELECT *, {ORIGIN} AS a FROM lineitem)) GROUP BY 1")
def quantity_label(spark, d):
    return _quantities(spark, d).groupBy(Q.label(F.col("q")).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {ACTIVITY_CTE} SELECT assay_id, assay_type, confidence_score, count(*) AS n FROM (SELECT a.assay_id, CASE WHEN s.s_suppkey % 2 = 0 THEN 'F' ELSE a.assay_type END AS assay_type, s.conf AS confidence_score FROM activity a LEFT JOIN (SELECT concat('A', s_suppkey) AS aid, s_suppkey, (s_suppkey % 9 + 1)::INT AS conf FROM supplier) s ON a.assay_id = s.aid) GROUP BY ALL")
def assay_left_join(spark, d):
    assays = table(spark, d, "supplier").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("assay_id"), F.when(F.col("s_suppkey") % 2 == 0, "F").alias("assay_type"), (F.col("s_suppkey") % 9 + 1).cast("int").alias("confidence_score"))
    return records.assemble(activity(spark, d), assays).groupBy("assay_id", "assay_type", "confidence_score").agg(F.count("*").alias("n"))


@query(f"WITH {ACTIVITY_CTE} SELECT count(*) FILTER (WHERE confidence_score IS NULL) AS no_confidence, count(*) FILTER (WHERE assay_type IS NULL) AS no_assay_type, count(*) FILTER (WHERE value IS NULL) AS no_value FROM activity")
def missing_metadata(spark, d):
    return records.missing_metadata(activity(spark, d))


@query("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS n_excluded FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def overlap_anti_join(spark, d):
    known = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rest, n = background.exclude(table(spark, d, "orders"), known, "o_custkey")
    return rest.select("o_orderkey", "o_custkey").crossJoin(F.broadcast(n))  # one row


@query("SELECT doc_id, EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text) AS is_known FROM documents d")
def known_semi_join(spark, d):
    known = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("key"))
    return similarity.mark_known(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key")), known).select("doc_id", "is_known")

@query("SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def first_seen_dedup(spark, d):
    return background.first_seen(table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "source"), "key", "doc_id")


@query("SELECT p_name AS key, min(p_partkey) AS representative, count(*) AS n FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1 UNION ALL SELECT NULL, p_partkey, 1 FROM part WHERE p_partkey % 11 = 0")
def structure_dedup(spark, d):
    p = table(spark, d, "part").withColumn("key", F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")))
    return background.representatives(p, "key", "p_partkey")

BG = "SELECT doc_id AS molecule_id, source, doc_id AS seq FROM documents"


@query("WITH t AS (SELECT doc_id AS molecule_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents WHERE doc_id % 7 <> 0) SELECT molecule_id, source, turn FROM t ORDER BY turn, source LIMIT 250")
def round_robin_background(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("molecule_id"), "source", F.col("doc_id").alias("seq"))
    return background.assemble(docs, 250, docs.where("seq % 7 = 0")).select("molecule_id", "source", "turn")


TURNS = "WITH t AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents WHERE doc_id % 7 <> 0), c AS (SELECT *, row_number() OVER (ORDER BY turn, source) AS k FROM t), p AS (SELECT * FROM c WHERE k <= 250), e AS (SELECT source, max(doc_id) AS last FROM p GROUP BY 1)"


@query(TURNS + " SELECT count(*) AS n, count(DISTINCT source) AS n_sources, (SELECT count(*) FROM documents JOIN e USING (source) WHERE doc_id % 7 = 0 AND (doc_id <= last OR (SELECT count(*) FROM p) < 250)) AS n_excluded, 0::BIGINT AS n_duplicates FROM p")
def background_account(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("molecule_id"), "source", F.col("doc_id").alias("seq"))
    a = background.account(docs, 250, docs.where("seq % 7 = 0"))
    return a.select("n", F.size("per_source").cast("long").alias("n_sources"), "n_excluded", "n_duplicates")


@query("WITH u AS (SELECT lang AS source, md5(text) AS molecule_id, min(doc_id) AS seq FROM documents WHERE trim(text) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM u) SELECT source, molecule_id, seq FROM r WHERE k <= 20")
def background_contributions(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("source"), F.md5("text").alias("molecule_id"), F.col("text").alias("smiles"), F.col("doc_id").alias("seq"))
    return background.contributions(docs, 20)[0].select("source", "molecule_id", "seq")


@query("SELECT count(*) AS n, count(DISTINCT lang) AS n_families, count(*) >= 200 AND count(DISTINCT lang) >= 3 AS usable FROM documents")
def background_usable(spark, d):
    return background.usable(table(spark, d, "documents"), "lang")


@query("SELECT floor((row_number() OVER (ORDER BY id) - 1) / 50)::BIGINT AS batch, id FROM (SELECT DISTINCT c_custkey::VARCHAR AS id FROM customer)")
def id_batches(spark, d):
    return paged.batches(table(spark, d, "customer"), "c_custkey").select("batch", F.explode("ids").alias("id"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def stale_entries(spark, d):
    return guards.stale(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())

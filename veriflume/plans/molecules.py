"""Queries on structures: a few that are given inline, and one for every part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import molecules
from ..operators import generation
from ..session import cut, ship
from .bridge import table
from .registry import query

KNOWN = [("ethanol", "CCO"), ("benzene", "c1ccccc1"), ("aspirin", "CC(=O)Oc1ccccc1C(=O)O"), ("caffeine", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"), ("sodium benzoate", "[Na+].[O-]C(=O)c1ccccc1"), ("toluene", "Cc1ccccc1"), ("quercetin", "O=c1c(O)c(-c2ccc(O)c(O)c2)oc2cc(O)cc(O)c12"), ("broken", "C1CC")]


def _known(spark):
    ship(spark)
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(KNOWN)], "seq long, name string, smiles string").select("*", molecules.structure(F.col("smiles")).alias("s"))


@query("SELECT * FROM (VALUES ('ethanol', 3, 0, 0, 1, true), ('benzene', 6, 1, 0, 1, true), ('aspirin', 13, 1, 0, 1, true), ('caffeine', 14, 2, 0, 1, true), ('sodium benzoate', 9, 1, -1, 2, true), ('toluene', 7, 1, 0, 1, true), ('quercetin', 22, 3, 0, 1, true), ('broken', NULL, NULL, NULL, NULL, false)) t(name, heavy_atoms, rings, formal_charge, n_fragments, valid)")
def molecule_descriptors(spark, d):
    return _known(spark).select("name", "s.heavy_atoms", "s.rings", "s.formal_charge", "s.n_fragments", F.col("s.error").isNull().alias("valid"))


@query("SELECT * FROM (VALUES ('ethanol', 46.1), ('benzene', 78.1), ('aspirin', 180.2), ('caffeine', 194.2), ('toluene', 92.1), ('quercetin', 302.2)) t(name, weight)")
def molecule_weights(spark, d):
    return _known(spark).where("s.error IS NULL AND s.n_fragments = 1").select("name", F.round("s.molecular_weight", 1).alias("weight"))


@query("SELECT * FROM (VALUES ('ethanol', '', 'acyclic'), ('benzene', 'toluene', 'shared'), ('toluene', 'benzene', 'shared')) t(name, twin, kind)")
def molecule_scaffolds(spark, d):
    k = _known(spark).where("name IN ('ethanol', 'benzene', 'toluene')").select("name", "s.scaffold")
    twin = k.select(F.col("name").alias("twin"), "scaffold").where("scaffold <> ''")
    out = k.join(twin, "scaffold", "left").where("twin IS NULL OR twin <> name")
    return out.select("name", F.coalesce("twin", F.lit("")).alias("twin"), F.when(F.col("scaffold") == "", "acyclic").otherwise("shared").alias("kind"))


TAILS = "CASE p_partkey % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'N' WHEN 2 THEN 'C(=O)O' WHEN 3 THEN 'c1ccccc1' ELSE 'C#N' END"
#: a chain of one to sixteen carbons with one of five groups at its end, for every part
MADE = f"SELECT p_partkey AS seq, p_partkey % 16 + 1 AS n, p_partkey % 5 AS tail, concat(repeat('C', CAST(p_partkey % 16 + 1 AS INT)), {TAILS}) AS smiles FROM {{part}}"
PICK = "(CASE tail WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END)"
HEAVY = "n + " + PICK.format(1, 1, 3, 6, 2)
MADE_CTE = "made AS (" + MADE.format(part="part") + ")"


def _made(spark, d):
    return spark.sql(MADE, part=table(spark, d, "part"))


@query(f"WITH {MADE_CTE} SELECT seq, {HEAVY} AS heavy_atoms, {PICK.format(0, 0, 0, 1, 0)} AS rings, {PICK.format(1, 1, 1, 0, 0)} AS hbd, {PICK.format(1, 1, 2, 0, 1)} AS hba, {PICK.format(20.23, 26.02, 37.3, 0.0, 23.79)}::DOUBLE AS tpsa, round(n * 12.011::DOUBLE + (2 * n + 1) * 1.008::DOUBLE + {PICK.format(17.007, 16.023, 45.017, 77.106, 26.018)}, 3) AS weight, {PICK.format(1, 1, 2, 0, 1)} AS heteroatoms FROM made")
def structure_descriptors(spark, d):
    s = _made(spark, d).select("seq", molecules.structure(F.col("smiles")).alias("s"))
    return s.select("seq", "s.heavy_atoms", "s.rings", "s.hbd", "s.hba", F.round("s.tpsa", 2).alias("tpsa"), F.round("s.molecular_weight", 3).alias("weight"), "s.heteroatoms")


@query(f"WITH {MADE_CTE} SELECT feature, count(*) AS n FROM (SELECT {PICK.format('NULL', chr(39) + 'primary_aliphatic_amine' + chr(39), chr(39) + 'carboxylic_acid' + chr(39), chr(39) + 'aromatic_ring' + chr(39), chr(39) + 'nitrile' + chr(39))} AS feature FROM made UNION ALL SELECT 'basic_nitrogen_any' FROM made WHERE tail = 1) WHERE feature IS NOT NULL GROUP BY 1")
def structure_features(spark, d):
    s = _made(spark, d).select(F.explode(molecules.structure(F.col("smiles"))["features"]).alias("feature", "k"))
    return s.groupBy("feature").agg(F.count("*").alias("n"))


@query(f"WITH {MADE_CTE} SELECT seq, 12 AS n_features, true AS valid, 0::BIGINT AS n_errors FROM made")
def descriptor_matrix(spark, d):
    row, error = molecules.descriptor_row(molecules.structure(F.col("smiles")))
    return _made(spark, d).select("seq", F.size(row).alias("n_features"), row.isNotNull().alias("valid"), error.isNotNull().cast("long").alias("n_errors"))


@query(f"WITH {MADE_CTE} SELECT seq, count(*) OVER (PARTITION BY n, tail) AS n_same, false AS charge_changed, true AS stripped FROM made")
def structure_keys(spark, d):
    """Structures with a counter-ion added, standardised: each distinct text is parsed once, and its key is that without the ion."""
    made = _made(spark, d)
    keyed = molecules.standardise_table(made.select("seq", F.concat("smiles", F.lit(".[Na+]")).alias("smiles")))
    plain = molecules.standardise_table(made.select(F.col("seq").alias("other"), "smiles"), out="plain").groupBy(F.col("plain.key").alias("key")).agg(F.count("*").alias("n_same"))
    return keyed.select("seq", F.col("standard.key").alias("key"), "standard.charge_changed", F.col("standard.parent_changed").alias("stripped")).join(plain, "key").select("seq", "n_same", "charge_changed", "stripped")


@query(f"WITH {MADE_CTE}, f AS (SELECT *, min(seq) OVER (PARTITION BY n, tail) AS first, {HEAVY} AS heavy FROM made) SELECT coalesce(CASE WHEN seq > first THEN 'duplicate' WHEN heavy < 12 THEN 'too_small' WHEN heavy > 16 THEN 'too_large' WHEN tail = 2 THEN 'already_known' END, 'kept') AS drop_stage, count(*) AS n FROM f GROUP BY 1")
def generation_attrition(spark, d):
    """The cascade over every part's structure, all acids being known, with similarities that rule nothing out."""
    made = _made(spark, d)
    policy = generation.GenerationPolicy(max_heavy_atoms=16, max_similarity_to_known=2.0, max_similarity_to_kept=2.0)
    return generation.attrition(generation.cascade(made.select("seq", "smiles"), made.where("tail = 2").select("smiles").distinct(), policy))


@query(f"WITH {MADE_CTE}, f AS (SELECT CASE WHEN {HEAVY} < 6 THEN 'too_small' WHEN {HEAVY} > 16 THEN 'too_large' END AS rule FROM made) SELECT count(*) AS n, round(avg((rule IS NULL)::INT), 9) AS pass_rate, avg((rule IS NULL)::INT) < 0.8 AS suspect, (SELECT rule FROM f WHERE rule IS NOT NULL GROUP BY rule ORDER BY count(*) DESC, rule DESC LIMIT 1) AS dominant_rule FROM f")
def policy_audit(spark, d):
    a = generation.audit(_made(spark, d).select("seq", "smiles"), generation.GenerationPolicy(min_heavy_atoms=6, max_heavy_atoms=16))
    return a.select("n", F.round("pass_rate", 9).alias("pass_rate"), "suspect", "dominant_rule")


@query(f"WITH {MADE_CTE} SELECT count(DISTINCT n) + 1 AS n_fragments, 1::BIGINT AS n_anchored, count(DISTINCT n) AS n_plain FROM made WHERE tail = 3")
def fragment_union(spark, d):
    """Fragments of all phenyl chains: the ring and a chain of every length, told apart by an anchoring feature."""
    parts = cut(generation.fragments(_made(spark, d).where("tail = 3")))  # read three times
    anchored, plain = generation.by_motif(parts, ("aromatic_ring",))
    return parts.agg(F.count("*").alias("n_fragments")).crossJoin(anchored.agg(F.count("*").alias("n_anchored"))).crossJoin(plain.agg(F.count("*").alias("n_plain")))  # one row each


@query(f"WITH {MADE_CTE} SELECT DISTINCT n AS size FROM made WHERE tail = 3")
def recombined(spark, d):
    """The ring as the seed, and every chain put on it once: the phenyl chains themselves."""
    anchored, plain = generation.by_motif(generation.fragments(_made(spark, d).where("tail = 3")), ("aromatic_ring",))
    return generation.recombine(plain, 2, seeds=anchored).select((F.col("size") - 6).cast("long").alias("size"))


@query()
def molecule_cascade(spark, d):
    """Generation from the known structures, through the whole cascade."""
    ship(spark)
    known = spark.createDataFrame([(s,) for _, s in KNOWN], "smiles string")
    out, _ = generation.generate(known, known, generation.GenerationPolicy(min_heavy_atoms=6))
    return generation.attrition(out)


@query()
def molecule_fragments(spark, d):
    return generation.fragments(_known(spark))

"""Queries on fixed-width structure text, point sets and boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import molecules
from ..operators import structure
from .bridge import table
from .registry import query

POINTS = "SELECT vec_id AS ix, label AS grp, embedding[1]::DOUBLE * 30 AS x, embedding[2]::DOUBLE * 30 AS y, embedding[3]::DOUBLE * 30 AS z FROM embeddings"


def _points(spark, d):
    at = lambda i, n: (F.col("embedding")[i].cast("double") * 30).alias(n)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ix"), F.col("label").alias("grp"), at(0, "x"), at(1, "y"), at(2, "z"))


def _lines(spark, d):
    """Structure text made of the points: one chain a label, numbered by row."""
    p = _points(spark, d).where("grp IS NOT NULL")
    atoms = p.select(
        F.lit("S1").alias("structure_id"), F.col("ix").alias("line_no"), (F.col("grp") == 9).alias("is_hetatm"), (F.col("ix") % 100000).cast("int").alias("serial"), F.when(F.col("ix") % 2 == 0, "CA").otherwise("CB").alias("name"), F.lit("").alias("alt_loc"),
        F.when(F.col("grp") == 9, "LIG").when(F.col("ix") % 3 == 0, "ALA").otherwise("GLY").alias("residue_name"), F.chr(F.col("grp") + 65).alias("chain"), ((F.col("ix") / 4).cast("int") % 10000).alias("residue_seq"),
        "x", "y", "z", F.lit(1.0).alias("occupancy"), F.lit(10.0).alias("b_factor"), F.lit("C").alias("element"),
    )
    head = ["HEADER    HYDROLASE" + " " * 43 + "1ABC", "TITLE     A STRUCTURE MADE", "TITLE    2 OF POINTS", "EXPDTA    X-RAY DIFFRACTION", "REMARK   2 RESOLUTION.    3.20 ANGSTROMS."]
    head = spark.createDataFrame([("S1", i - 10, v) for i, v in enumerate(head)], "structure_id string, line_no long, value string")
    return head.unionByName(atoms.select("structure_id", "line_no", structure.format_atom().alias("value")))


ATOMS = f"atm AS (SELECT ix AS line_no, CASE WHEN ix % 2 = 0 THEN 'CA' ELSE 'CB' END AS name, CASE WHEN grp = 9 THEN 'LIG' WHEN ix % 3 = 0 THEN 'ALA' ELSE 'GLY' END AS residue_name, chr(grp + 65) AS chain, ((ix // 4) % 10000)::INT AS residue_seq, grp = 9 AS is_hetatm, x, y, z FROM ({POINTS}) WHERE grp IS NOT NULL)"


@query(f"WITH {ATOMS} SELECT line_no, name, residue_name, chain, residue_seq, is_hetatm, round(x, 3) AS x FROM atm")
def pdb_atoms(spark, d):
    return structure.atoms(_lines(spark, d)).select("line_no", "name", "residue_name", "chain", "residue_seq", "is_hetatm", F.round("x", 3).alias("x"))


@query(f"WITH {ATOMS} SELECT chain, count(DISTINCT (residue_seq, residue_name)) AS n_residues FROM atm GROUP BY 1")
def chain_residues(spark, d):
    return structure.chains(structure.atoms(_lines(spark, d))).select("chain", "n_residues")


@query(f"WITH {ATOMS}, r AS (SELECT DISTINCT chain, residue_seq, residue_name FROM atm), c AS (SELECT chain, count(*) AS n, avg((residue_name IN ('ALA', 'GLY'))::INT) AS share FROM r GROUP BY 1) SELECT chain, share >= 0.6 AND n <= 30 AND n < (SELECT max(n) FROM c) / 2.0 AS is_peptide FROM c")
def peptide_chains(spark, d):
    return structure.chains(structure.atoms(_lines(spark, d))).select("chain", "is_peptide")


@query(f"WITH {ATOMS} SELECT chain, residue_seq, count(*) AS n_atoms FROM atm WHERE is_hetatm GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n_atoms DESC, min(line_no) LIMIT 1")
def ligand_pick(spark, d):
    found = structure.ligands(structure.atoms(_lines(spark, d)), min_atoms=2)
    return structure.best_ligand(found).select("chain", "residue_seq", "n_atoms")


@query(f"WITH {ATOMS}, r AS (SELECT DISTINCT chain, residue_seq, residue_name FROM atm), c AS (SELECT chain, count(*) AS n, avg((residue_name IN ('ALA', 'GLY'))::INT) AS share FROM r GROUP BY 1), p AS (SELECT chain FROM c WHERE share >= 0.6 AND n <= 30 AND n < (SELECT max(n) FROM c) / 2.0) SELECT line_no, chain FROM atm WHERE NOT is_hetatm AND chain NOT IN (SELECT chain FROM p)")
def receptor_strip(spark, d):
    return structure.receptor(structure.atoms(_lines(spark, d))).select("line_no", "chain")


@query(f"SELECT grp, round((max(x) + min(x)) / 2, 4) AS center_x, round(greatest(12, max(x) - min(x) + 8), 4) AS size_x, greatest(12, max(x) - min(x) + 8, max(y) - min(y) + 8, max(z) - min(z) + 8) > 30 AS is_blind, least(max(x) - min(x), max(y) - min(y), max(z) - min(z)) < 2 AS is_planar FROM ({POINTS}) GROUP BY 1")
def box_from_points(spark, d):
    return structure.box(_points(spark, d), "grp").select("grp", F.round("center_x", 4).alias("center_x"), F.round("size_x", 4).alias("size_x"), "is_blind", "is_planar")


@query(f"SELECT grp, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(avg(z), 4) AS cz, round(max(x) - min(x), 4) AS ex FROM ({POINTS}) GROUP BY 1")
def centroid_extent(spark, d):
    return structure.centroid(_points(spark, d), "grp").select("grp", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "cz", "ex")])


@query(f"WITH p AS ({POINTS}) SELECT count(*) AS n, round(sqrt(avg(3 * 0.25)), 6) AS rmsd FROM p")
def rmsd(spark, d):
    p = _points(spark, d)
    return structure.rmsd(p, p.withColumns({c: F.col(c) + 0.5 for c in "xyz"})).withColumn("rmsd", F.round("rmsd", 6))


@query(f"WITH p AS ({POINTS}), m AS (SELECT a.grp, a.ix, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON b.grp = (a.grp + 1) % 10 GROUP BY ALL) SELECT grp, round(sqrt(avg(d)), 6) AS rmsd FROM m GROUP BY 1")
def nn_rmsd(spark, d):
    """The points of every label against the nearest ones of the next label."""
    p = _points(spark, d)
    next_ = p.withColumn("grp", (F.col("grp") + 9) % 10)
    return structure.nearest_rmsd(p, next_, "grp").withColumn("rmsd", F.round("rmsd", 6))


@query(f"SELECT ix FROM ({POINTS}) WHERE x * x + (y - 1) * (y - 1) + z * z <= 16")
def atoms_within(spark, d):
    return structure.within(_points(spark, d), (0.0, 1.0, 0.0), 4.0).select("ix")


@query("WITH t AS (SELECT vec_id AS k, label AS n FROM embeddings), o AS (SELECT t.k - (m.k + 17) AS off, avg((m.n = t.n)::INT) AS a, count(*) AS c FROM t m, t WHERE abs(t.k - (m.k + 17)) <= 300 GROUP BY 1 HAVING count(*) >= 50) SELECT off AS \"offset\", c AS mapped, round(a, 9) AS agreement FROM o ORDER BY a DESC, off LIMIT 1")
def residue_offset(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("name"))
    return structure.residue_offset(e.withColumn("key", F.col("key") + 17), e).select("offset", "mapped", F.round("agreement", 9).alias("agreement"))


@query("SELECT 'S1' AS structure_id, '1ABC' AS pdb_id, 'A STRUCTURE MADE OF POINTS' AS title, 'X-RAY DIFFRACTION' AS method, 3.2::DOUBLE AS resolution")
def pdb_header(spark, d):
    return structure.header(_lines(spark, d))


@query("SELECT 'S1' AS structure_id, 'a low resolution of 3.20' AS warnings")
def pdb_warnings(spark, d):
    return structure.warnings(_lines(spark, d)).select("structure_id", F.array_join("warnings", "; ").alias("warnings"))


BOXED = "round((max(x) + min(x)) / 2, 3) AS center_x, round(greatest(12, max(x) - min(x) + {pad}), 3) AS size_x, count(*) AS n_atoms"


@query(f"WITH {ATOMS}, a AS (SELECT * REPLACE (round(x, 3) AS x) FROM atm), l AS (SELECT chain, residue_seq, residue_name FROM a WHERE is_hetatm GROUP BY ALL HAVING count(*) >= 2 ORDER BY count(*) DESC, min(line_no) LIMIT 1) SELECT {BOXED.format(pad=16)}, 'ligand LIG' AS derived_from FROM a JOIN l USING (chain, residue_seq, residue_name)")
def ligand_box(spark, d):
    a = structure.atoms(_lines(spark, d))
    b = structure.box_from_ligand(a, structure.best_ligand(structure.ligands(a, min_atoms=2)))
    return b.select(F.round("center_x", 3).alias("center_x"), F.round("size_x", 3).alias("size_x"), "n_atoms", "derived_from")


@query(f"WITH {ATOMS}, a AS (SELECT * REPLACE (round(x, 3) AS x) FROM atm WHERE NOT is_hetatm AND residue_seq IN (3, 5, 8)) SELECT {BOXED.format(pad=16)}, count(DISTINCT chain) > 1 AS several FROM a")
def residue_box(spark, d):
    b = structure.box_from_residues(structure.atoms(_lines(spark, d)), [3, 5, 8], evidence="made up")
    return b.select(F.round("center_x", 3).alias("center_x"), F.round("size_x", 3).alias("size_x"), "n_atoms", F.exists("warnings", lambda w: w.startswith("the residues are on chains")).alias("several"))


@query(f"WITH {ATOMS}, a AS (SELECT * REPLACE (round(x, 3) AS x) FROM atm WHERE NOT is_hetatm) SELECT {BOXED.format(pad=8)} FROM a")
def whole_box(spark, d):
    b = structure.blind_box(structure.atoms(_lines(spark, d)))
    return b.select(F.round("center_x", 3).alias("center_x"), F.round("size_x", 3).alias("size_x"), "n_atoms")


@query(f"WITH {ATOMS}, c AS (SELECT residue_seq AS key, arg_min(residue_name, line_no) AS name, arg_min(x, line_no) AS x FROM atm WHERE name = 'CA' GROUP BY 1) SELECT a.key, round(round(a.x, 3) - round(b.x, 3), 3) AS dx FROM c a JOIN c b ON b.key = a.key + 3 AND a.name = b.name")
def carbon_pairs(spark, d):
    c = structure.alpha_carbons(structure.atoms(_lines(spark, d)))
    return structure.paired(c, c, 3).select("key", F.round(F.col("ax") - F.col("bx"), 3).alias("dx"))


@query(f"WITH {ATOMS}, r AS (SELECT DISTINCT chain, residue_seq, residue_name FROM atm), c AS (SELECT chain, count(*) AS n, avg((residue_name IN ('ALA', 'GLY'))::INT) AS share FROM r GROUP BY 1), p AS (SELECT chain FROM c WHERE share >= 0.6 AND n <= 30 AND n < (SELECT max(n) FROM c) / 2.0) SELECT chain, residue_seq, chain IN (SELECT chain FROM p) AS is_fragment FROM atm WHERE is_hetatm GROUP BY ALL HAVING count(*) >= 2")
def ligand_fragments(spark, d):
    a = structure.atoms(_lines(spark, d))
    return structure.on_peptide(structure.ligands(a, min_atoms=2), structure.chains(a)).select("chain", "residue_seq", "is_fragment")


@query(f"WITH p AS ({POINTS}), m AS (SELECT a.grp, a.ix, min((a.x - b.x - 0.5) ** 2 + (a.y - b.y - 0.5) ** 2 + (a.z - b.z - 0.5) ** 2) AS d FROM p a JOIN p b ON b.grp = a.grp GROUP BY ALL) SELECT grp AS ligand, round(sqrt(avg(d)), 6) AS rmsd, sqrt(avg(d)) < 2 AS passed, count(*) || ' docked atoms against ' || count(*) AS detail FROM m GROUP BY 1")
def redocked(spark, d):
    """Every label's points against themselves moved by half a unit along each axis."""
    p = _points(spark, d).where("grp IS NOT NULL").withColumnRenamed("grp", "ligand")
    moved = p.groupBy("ligand").agg(F.collect_list(F.struct(*[(F.col(c) + 0.5).alias(c) for c in "xyz"])).alias("points"))  # a pose is an array by contract
    poses = moved.select("ligand", F.lit(1).alias("rank"), F.lit(-9.0).alias("score"), "points", F.lit(None).cast("string").alias("error"))
    return structure.redock(p, poses).select("ligand", F.round("rmsd", 6).alias("rmsd"), "passed", "detail")


@query("SELECT count(*) AS n, 0.0::DOUBLE AS residual, round(cos(0.4), 6) AS r00, round(sin(0.4), 6) AS r10 FROM embeddings WHERE embedding IS NOT NULL")
def kabsch(spark, d):
    p = _points(spark, d)
    c, s = float(np.cos(0.4)), float(np.sin(0.4))
    turned = p.select(*[F.col(v).alias(f"a{v}") for v in "xyz"], (c * F.col("x") - s * F.col("y") + 1).alias("bx"), (s * F.col("x") + c * F.col("y") - 2).alias("by"), (F.col("z") + 3).alias("bz"))
    rotation, _, _, residual, n = structure.kabsch(turned)
    return spark.createDataFrame([(n, round(residual, 3), round(float(rotation[0, 0]), 6), round(float(rotation[1, 0]), 6))], "n long, residual double, r00 double, r10 double")


@query("SELECT p_partkey AS id, (p_retailprice > 1200)::INT + (p_size > 40)::INT + (p_partkey % 7 > 5)::INT + (p_partkey % 12 > 10)::INT AS violations FROM part")
def lipinski(spark, d):
    p = table(spark, d, "part")
    v = molecules.lipinski_violations(F.col("p_retailprice") / 2.4, F.col("p_size") / 8.0, F.col("p_partkey") % 7, F.col("p_partkey") % 12)
    return p.select(F.col("p_partkey").alias("id"), v.alias("violations"))


@query(f"SELECT grp, count(*) FILTER (WHERE abs(x - 1) <= 5 AND abs(y) <= 5 AND abs(z) <= 5) AS inside, count(*) AS n FROM ({POINTS}) GROUP BY 1")
def box_contains(spark, d):
    inside = structure.contains(F.lit(1.0), F.lit(10.0), F.col("x")) & structure.contains(F.lit(0.0), F.lit(10.0), F.col("y")) & structure.contains(F.lit(0.0), F.lit(10.0), F.col("z"))
    return _points(spark, d).groupBy("grp").agg(F.count_if(inside).alias("inside"), F.count("*").alias("n"))

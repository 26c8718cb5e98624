"""Fixed-width structure text, point sets and boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .knn import nearest
from .ranking import running_total

MIN_LIGAND_ATOMS, BLIND_EDGE, MIN_EDGE, PLANAR = 8, 30.0, 12.0, 2.0
#: names of residues of proteins (fixed values)
RESIDUES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE SEC PYL".split()

# Residues that are water, ions, buffers, cryoprotectants, sugars or lipids, not ligands.
ADDITIVES = (
    "HOH WAT DOD H2O NA K MG CA ZN FE FE2 MN CU CU1 NI CO CD HG CS RB SR BA LI AL CL BR IOD F GOL EDO PEG PG4 PGE 1PE 2PE P6G XPE 7PE MPD DMS SO4 PO4 NO3 CO3 ACT ACY FMT TRS "
    "MES EPE BTB CIT TAR MLA MLI IMD BME DTT NH4 AZI CYN SCN URE ETH IPA MOH EOH SIN OXL NAG NDG BMA MAN FUC GAL GLC BGC XYS PLM MYR OLA STE"
).split()


def number(line: Column, start: int, size: int, kind: str = "double") -> Column:
    return F.trim(F.substring(line, start, size)).try_cast(kind)


def first_model(lines: DataFrame) -> DataFrame:
    """Lines (structure_id, line_no, value) up to where a model other than the first begins."""
    v = F.col("value")
    later = (F.substring(v, 1, 6) == "MODEL ") & ~F.trim(F.substring(v, 11, 4)).isin("", "1")
    seen = F.max(F.when(later, 1).otherwise(0)).over(Window.partitionBy("structure_id").orderBy("line_no"))
    return lines.withColumn("__later", seen).where("__later = 0").drop("__later")


def atoms(lines: DataFrame, keep_hydrogens: bool = False) -> DataFrame:
    """Atoms of (structure_id, line_no, value): first model, main alternative only; lines without coordinates are dropped.

    A blank chain is A; numbers that cannot be read are 0, an occupancy 1.
    """
    v = F.col("value")
    word = lambda a, n: F.trim(F.substring(v, a, n))
    df = first_model(lines).where(F.substring(v, 1, 6).isin("ATOM  ", "HETATM"))
    guessed = F.substring(F.ltrim(word(13, 2), F.lit("0123456789")), 1, 1)
    filled = lambda c, other: F.when(F.coalesce(c, F.lit(0)) == 0, other).otherwise(c)
    df = df.select(
        "structure_id", "line_no", filled(number(v, 7, 5, "int"), 0).alias("serial"), word(13, 4).alias("name"), word(17, 1).alias("alt_loc"), word(18, 3).alias("residue_name"), F.when(word(22, 1) == "", "A").otherwise(word(22, 1)).alias("chain"), filled(number(v, 23, 4, "int"), 0).alias("residue_seq"),
        number(v, 31, 8).alias("x"), number(v, 39, 8).alias("y"), number(v, 47, 8).alias("z"), filled(number(v, 55, 6), F.lit(1.0)).alias("occupancy"), filled(number(v, 61, 6), F.lit(0.0)).alias("b_factor"),
        F.when(word(77, 2) == "", guessed).otherwise(word(77, 2)).alias("element"), (F.substring(v, 1, 6) == "HETATM").alias("is_hetatm"),
    )
    df = df.where(F.col("alt_loc").isin("", "A", "1") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return df if keep_hydrogens else df.where(F.upper("element") != "H")


def header(lines: DataFrame) -> DataFrame:
    """(structure_id, pdb_id, title, method, resolution) of every structure, '' or NULL where a record is missing. A structure's header lines are few."""
    v = F.col("value")
    kinds = {"HEADER": F.trim(F.substring(v, 63, 4)), "TITLE ": F.trim(F.substring(v, 11, 70)), "EXPDTA": F.trim(F.substring(v, 11, 69)), "REMARK": F.when(v.startswith("REMARK   2 RESOLUTION."), F.trim(F.substring(v, 24, 7)))}
    rows = first_model(lines).withColumn("__k", F.substring(v, 1, 6))
    text = F.coalesce(*[F.when(F.col("__k") == k, t) for k, t in kinds.items()])
    rows = rows.withColumn("__t", text).withColumn("__at", F.when(F.col("__t").isNotNull(), F.struct("line_no", "__k", "__t")))
    per = rows.groupBy("structure_id").agg(F.array_sort(F.collect_list("__at")).alias("h"))
    of = lambda k: F.transform(F.filter("h", lambda x: x["__k"] == k), lambda x: x["__t"])
    numbers = F.filter(F.transform(of("REMARK"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    said = lambda k: F.trim(F.array_join(of(k), " "))
    return per.select("structure_id", F.coalesce(F.try_element_at(of("HEADER"), F.lit(-1)), F.lit("")).alias("pdb_id"), said("TITLE ").alias("title"), said("EXPDTA").alias("method"), F.try_element_at(numbers, F.lit(-1)).alias("resolution"))


def warnings(lines: DataFrame, low_resolution: float = 3.0) -> DataFrame:
    """(structure_id, warnings): what to know before docking into a structure; an empty list of most."""
    v = F.col("value")
    kept = first_model(lines).where(F.substring(v, 1, 6).isin("ATOM  ", "HETATM"))
    bad = number(v, 31, 8).isNull() | number(v, 39, 8).isNull() | number(v, 47, 8).isNull()
    alternative = F.when(~bad & (F.trim(F.substring(v, 17, 1)) != ""), F.trim(F.substring(v, 17, 1)))
    per = kept.groupBy("structure_id").agg(F.count_if(bad).alias("bad"), F.array_sort(F.collect_set(alternative)).alias("alt"))
    protein = atoms(lines).where("NOT is_hetatm").groupBy("structure_id").agg(F.count("*").alias("protein"))
    out = header(lines).join(per, "structure_id", "left").join(protein, "structure_id", "left")
    r, xray = F.col("resolution"), F.contains(F.upper("method"), F.lit("X-RAY"))
    said = [
        F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" coordinate lines cannot be read"))), F.when(F.size("alt") > 0, F.concat(F.lit("alternative positions "), F.array_join("alt", ", "), F.lit(": the first is kept"))),
        F.when(F.col("protein").isNull(), "no protein atoms"), F.when(r.isNull() & xray, "no resolution, though by X-ray"), F.when(r > low_resolution, F.format_string("a low resolution of %.2f", r)),
    ]
    return out.select("structure_id", F.array_compact(F.array(*said)).alias("warnings"))

def malformed(lines: DataFrame) -> DataFrame:
    v = F.col("value")
    bad = number(v, 31, 8).isNull() | number(v, 39, 8).isNull() | number(v, 47, 8).isNull()
    return lines.where(F.trim(F.substring(v, 1, 6)).isin("ATOM", "HETATM") & bad).groupBy("structure_id").agg(F.count("*").alias("n_malformed"))


def format_atom() -> Column:
    """One fixed-width line of an atom row; four-letter names start a column early."""
    name = F.when(F.length("name") >= 4, F.rpad("name", 4, " ")).otherwise(F.concat(F.lit(" "), F.rpad("name", 3, " ")))
    return F.concat(
        F.rpad(F.when(F.col("is_hetatm"), "HETATM").otherwise("ATOM"), 6, " "), F.lpad(F.col("serial").cast("string"), 5, " "), F.lit(" "), name, F.rpad("alt_loc", 1, " "), F.lpad("residue_name", 3, " "), F.lit(" "), F.rpad("chain", 1, " "),
        F.lpad(F.col("residue_seq").cast("string"), 4, " "), F.lit("    "), F.format_string("%8.3f%8.3f%8.3f%6.2f%6.2f", "x", "y", "z", F.coalesce("occupancy", F.lit(1.0)), F.coalesce("b_factor", F.lit(0.0))), F.lit(" " * 10), F.lpad("element", 2, " "),
    )


def chains(a: DataFrame) -> DataFrame:
    """(structure_id, chain, n_residues, protein_share, is_peptide) of polymer chains: short protein chains beside one more than twice as long are peptides."""
    residues = a.select("structure_id", "chain", "residue_seq", "residue_name").distinct()
    per = residues.groupBy("structure_id", "chain").agg(F.count("*").alias("n_residues"), F.avg(F.col("residue_name").isin(RESIDUES).cast("double")).alias("protein_share"))
    largest = F.max("n_residues").over(Window.partitionBy("structure_id"))
    return per.withColumn("is_peptide", (F.col("protein_share") >= 0.6) & (F.col("n_residues") <= 30) & (F.col("n_residues") < largest / 2))


def by_size(chains_: DataFrame) -> DataFrame:
    """Chains in the order of a report: the longest of a structure first, ties by name."""
    return chains_.orderBy("structure_id", F.desc("n_residues"), "chain")


def receptor_chains(chains_: DataFrame) -> DataFrame:
    return chains_.where("NOT is_peptide")


def on_peptide(ligands_: DataFrame, chains_: DataFrame) -> DataFrame:
    """ligands with is_fragment: it lies on the chain of a peptide ligand, so it is a piece of that, not the ligand."""
    p = chains_.where("is_peptide").select("structure_id", "chain", F.lit(True).alias("__p"))
    return ligands_.join(p, ["structure_id", "chain"], "left").withColumn("is_fragment", F.coalesce("__p", F.lit(False))).drop("__p")

def ligands(a: DataFrame, additives: list[str] = ADDITIVES, min_atoms: int = MIN_LIGAND_ATOMS) -> DataFrame:
    """Candidate ligands (structure_id, chain, residue_name, residue_seq, n_atoms), not additives, with carbon, largest first."""
    het = a.where("is_hetatm").where(~F.col("residue_name").isin(additives))
    per = het.groupBy("structure_id", "chain", "residue_name", "residue_seq").agg(F.count_if(F.col("element") != "H").alias("n_atoms"), F.count_if(F.col("element") == "C").alias("n_carbon"), F.min("line_no").alias("first_line"))
    return per.where((F.col("n_atoms") >= min_atoms) & (F.col("n_carbon") > 0)).drop("n_carbon")


def best_ligand(candidates: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("structure_id").orderBy(F.desc("n_atoms"), "first_line"))
    return candidates.withColumn("r", rank).where("r = 1").drop("r")


def receptor(a: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Protein atoms without peptide ligands, of some chains if given."""
    peptides = chains(a).where("is_peptide").select("structure_id", "chain")
    out = a.where("NOT is_hetatm").join(peptides, ["structure_id", "chain"], "left_anti")
    return out.where(F.col("chain").isin(keep)) if keep else out


def box(points: DataFrame, by: str, padding: float = 4.0) -> DataFrame:
    """Bounding box of points (x, y, z) by key: centre, edges of MIN_EDGE at least, warnings."""
    out = points.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    extent = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"}
    edges = {c: F.greatest(F.lit(MIN_EDGE), extent[c] + 2 * padding) for c in "xyz"}
    return out.select(by, *[((F.col(f"max_{c}") + F.col(f"min_{c}")) / 2).alias(f"center_{c}") for c in "xyz"], *[edges[c].alias(f"size_{c}") for c in "xyz"], (F.greatest(*edges.values()) > BLIND_EDGE).alias("is_blind"), (F.least(*extent.values()) < PLANAR).alias("is_planar"))


def _boxed(points: DataFrame, padding: float, said: list[Column], derived_from: str | Column, evidence: str | Column, extra: list[Column]) -> DataFrame:
    """One box a structure_id, with where it comes from, the evidence for it, and warnings."""
    b = box(points, "structure_id", padding)
    b = b.join(points.groupBy("structure_id").agg(F.count("*").alias("n_atoms"), *extra), "structure_id")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    said = [F.when(F.col("is_blind"), f"a side over {BLIND_EDGE:g}: the search is blind in effect"), F.when(F.col("is_planar"), "the points are nearly in a plane"), *said]
    return b.select("structure_id", *[f"center_{c}" for c in "xyz"], *[f"size_{c}" for c in "xyz"], "n_atoms", lit(derived_from).alias("derived_from"), lit(evidence).alias("evidence"), F.array_compact(F.array(*said)).alias("warnings"))


def box_from_ligand(a: DataFrame, ligand: DataFrame, padding: float = 8.0, few: int = 12) -> DataFrame:
    """The box around each structure's ligand (structure_id, chain, residue_name, residue_seq): the only one an experiment stands behind."""
    key = ["structure_id", "chain", "residue_name", "residue_seq"]
    heavy = a.where("is_hetatm").where(F.upper("element") != "H").join(ligand.select(*key), key)
    name = F.first("residue_name").alias("__name")
    small = F.when(F.col("n_atoms") < few, F.concat(F.lit("only "), F.col("n_atoms").cast("string"), F.lit(" heavy atoms: a larger molecule may need more room")))
    return _boxed(heavy, padding, [small], F.concat(F.lit("ligand "), F.col("__name")), F.concat(F.col("n_atoms").cast("string"), F.lit(" heavy atoms observed")), [name])


def box_from_residues(a: DataFrame, numbers: list[int], chain: str | None = None, padding: float = 8.0, evidence: str = "") -> DataFrame:
    """The box around protein residues by number, of one chain if given; a structure that has none of them gives no row."""
    found = a.where("NOT is_hetatm").where(F.col("residue_seq").isin(list(numbers)))
    found = found if chain is None else found.where(F.col("chain") == chain)
    several = F.when(F.size("__chains") > 1, F.concat(F.lit("the residues are on chains "), F.array_join("__chains", ", "), F.lit(": the centre may lie between them"))) if chain is None else F.lit(None).cast("string")
    unproven = F.lit(None if evidence else "nothing is said for these residues").cast("string")
    where = "residues " + ", ".join(map(str, sorted(set(numbers)))) + (f" of chain {chain}" if chain else "")
    return _boxed(found, padding, [several, unproven], where, evidence or "the caller's choice", [F.array_sort(F.collect_set("chain")).alias("__chains")])


def blind_box(a: DataFrame, padding: float = 4.0) -> DataFrame:
    """The box over all protein atoms: a last resort, and marked as one."""
    return _boxed(a.where("NOT is_hetatm"), padding, [F.lit("the whole protein is searched: a score from this box is no evidence of binding")], "whole protein", "no site is known", [])


def structure_text(a: DataFrame) -> DataFrame:
    """(structure_id, text): each structure's atoms as fixed-width lines in order, with an END line."""
    lines = a.select("structure_id", F.struct("line_no", format_atom().alias("v")).alias("l"))
    text = F.array_join(F.concat(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["v"]), F.array(F.lit("END"))), "\n")
    return lines.groupBy("structure_id").agg(text.alias("text"))


def write_structures(a: DataFrame, path: str) -> None:
    """A file `<structure_id>.pdb` for each structure: its atoms as fixed-width lines in order, with an END line."""
    from ..sources.sinks import write_lines

    write_lines(a.select("structure_id", "line_no", format_atom().alias("v")), path, "structure_id", ["line_no"], "v", ".pdb", "END")


def contains(cx: Column, sx: Column, x: Column) -> Column:
    return F.abs(x - cx) <= sx / 2


def centroid(points: DataFrame, by: str) -> DataFrame:
    return points.groupBy(by).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"], *[(F.max(c) - F.min(c)).alias(f"e{c}") for c in "xyz"])


def rmsd(a: DataFrame, b: DataFrame, on: str = "ix") -> DataFrame:
    """Root mean square deviation of points paired by ordinal; NULL unless both have the same ordinals."""
    d2 = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"), F.lit(0.0))
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{on}") == F.col(f"b.{on}"), "full")
    return both.agg(F.count_if(F.col(f"a.{on}").isNull() | F.col(f"b.{on}").isNull()).alias("odd"), F.sqrt(F.avg(d2)).alias("r"), F.count(F.lit(1)).alias("n")).select("n", F.when(F.col("odd") == 0, F.col("r")).alias("rmsd"))


def nearest_rmsd(reference: DataFrame, points: DataFrame, by: str | None = None) -> DataFrame:
    """Deviation of each reference point from its nearest point, in whatever order; by: of each group from the points of its own.

    Groups are kept apart by a coordinate of their own, further than any two points are from each other, so that all of them take one join.
    Points without a group are left out, and so are groups that have no points.
    """
    if by is None:
        at = lambda df: df.select(F.col("ix").alias("id"), F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("features"))
        near = nearest(at(reference), at(points), 1)
        return near.select(F.get("near", F.lit(0))["d"].alias("d")).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmsd"))
    far = 4 * sum((max(abs(v) for v in r) if (r := df.agg(*[f(c).cast("double") for c in "xyz" for f in (F.min, F.max)]).first())[0] is not None else 0.0) for df in (reference, points)) + 1
    groups = points.select(by).where(F.col(by).isNotNull()).distinct()
    placed = running_total(groups, [by], out="__g")
    at = lambda df: df.join(placed, by).select(F.col("ix").alias("id"), by, F.array(*[F.col(c).cast("double") for c in "xyz"], F.col("__g") * F.lit(float(far))).alias("features"))
    mine = at(reference)
    d = F.get("near", F.lit(0))["d"]
    return nearest(mine, at(points), 1).join(mine.select("id", by), "id").groupBy(by).agg(F.sqrt(F.avg(d * d)).alias("rmsd"))


def within(points: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    d2 = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("xyz", centre)), F.lit(0.0))
    return points.where(d2 <= radius * radius)


def alpha_carbons(a: DataFrame, chain: str | None = None) -> DataFrame:
    """(structure_id, key, name, x, y, z): the first alpha carbon of each residue number, of one chain if given."""
    found = a.where(F.col("name") == "CA")
    found = found if chain is None else found.where(F.col("chain") == chain)
    first = F.min_by(F.struct(F.col("residue_name").alias("name"), "x", "y", "z"), "line_no")
    return found.groupBy("structure_id", F.col("residue_seq").alias("key")).agg(first.alias("f")).select("structure_id", "key", "f.*")


def paired(mobile: DataFrame, target: DataFrame, offset: int) -> DataFrame:
    """(key, ax..az, bx..bz) of residues (key, name, x, y, z) that agree in name under an offset of their numbers."""
    m = mobile.select("key", "name", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    t = target.select((F.col("key") - offset).alias("key"), "name", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return m.join(t, ["key", "name"]).drop("name")


MIN_AGREEMENT, MIN_PAIRS, MAX_RESIDUAL = 0.9, 50, 2.0


def residue_offset(mobile: DataFrame, target: DataFrame, limit: int = 300, min_mapped: int = MIN_PAIRS) -> DataFrame:
    """(offset, mapped, agreeing, agreement, trusted): the numbering offset under which most residues (key, name) agree, the lowest on ties.

    Every offset in one pass: names that agree vote for theirs; mapped counts come from keys alone. Nothing maps: no row.
    """
    m, t = mobile.select(F.col("key").alias("mk"), F.col("name").alias("mn")), target.select(F.col("key").alias("tk"), F.col("name").alias("tn"))
    # mobile residues visit each target residue within the limit, by buckets of that width
    b = F.floor(F.col("mk") / limit)
    pairs = m.withColumn("k", F.explode(F.array(b - 1, b, b + 1))).join(t.withColumn("k", F.floor(F.col("tk") / limit)), "k").withColumn("offset", F.col("tk") - F.col("mk")).where(F.abs("offset") <= limit)
    per = pairs.groupBy("offset").agg(F.count("*").alias("mapped"), F.count_if(F.col("mn") == F.col("tn")).alias("agreeing")).withColumn("agreement", F.col("agreeing") / F.col("mapped"))
    best = per.where(F.col("mapped") >= min_mapped).where("agreeing > 0").orderBy(F.desc("agreement"), "offset").limit(1)
    return best.withColumn("trusted", (F.col("agreement") >= MIN_AGREEMENT) & (F.col("agreeing") >= MIN_PAIRS))


def trusted_fit(residual: float, n: int) -> bool:
    """Whether a superposition may carry points from one structure into another."""
    return residual < MAX_RESIDUAL and n >= MIN_PAIRS


def redock(crystal: DataFrame, poses: DataFrame, limit: float = 2.0) -> DataFrame:
    """(ligand, rmsd, score, passed, detail) of docked ligands against their crystal positions.

    crystal: (ligand, ix, x, y, z); poses: (ligand, rank, score, points array<struct<x, y, z>>, error). The top pose counts, each
    crystal atom against its nearest one: a lower bound, for telling a hit from a miss. No pose or no points: rmsd is NULL, not passed.
    """
    top = poses.groupBy("ligand").agg(F.min_by(F.struct("score", "points", "error"), "rank").alias("p")).select("ligand", "p.*")
    docked = top.select("ligand", F.posexplode("points")).select("ligand", F.monotonically_increasing_id().alias("ix"), "col.x", "col.y", "col.z")  # ids of one use
    size = crystal.groupBy("ligand").agg(F.count("*").alias("n"))
    ix = crystal.select(F.struct("ligand", "ix").alias("ix"), "ligand", "x", "y", "z")
    out = top.join(nearest_rmsd(ix, cut(docked), "ligand"), "ligand", "left").join(size, "ligand", "left")
    detail = F.coalesce("error", F.when(F.coalesce(F.size("points"), F.lit(0)) <= 0, "the top pose has no atoms"), F.concat(F.size("points").cast("string"), F.lit(" docked atoms against "), F.col("n").cast("string")))
    return out.select("ligand", "rmsd", "score", F.coalesce(F.col("rmsd") < limit, F.lit(False)).alias("passed"), detail.alias("detail"))


def kabsch(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """(rotation, mobile centroid, target centroid, residual, n) of paired points (ax..az onto bx..bz), from 16 sums."""
    a, b = [f"a{c}" for c in "xyz"], [f"b{c}" for c in "xyz"]
    s = pairs.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in a + b], *[F.sum(F.col(p) * F.col(q)).alias(f"{p}{q}") for p in a for q in b], *[F.sum(F.col(p) * F.col(p)).alias(f"s{p}") for p in a + b]).first()
    n = s["n"]
    if n < 3:
        raise ValueError("three pairs at least")
    ma, mb = np.array([s[c] / n for c in a]), np.array([s[c] / n for c in b])
    cov = np.array([[s[f"{p}{q}"] for q in b] for p in a]) - n * np.outer(ma, mb)
    u, d, vt = np.linalg.svd(cov)
    sign = np.sign(np.linalg.det(vt.T @ u.T))
    rotation = vt.T @ np.diag([1, 1, sign]) @ u.T
    spread = sum(s[f"s{c}"] for c in a) - n * ma @ ma + sum(s[f"s{c}"] for c in b) - n * mb @ mb
    residual = float(np.sqrt(max(0.0, spread - 2 * (d[0] + d[1] + sign * d[2])) / n))
    return rotation, ma, mb, residual, n


def superpose(points: DataFrame, rotation: np.ndarray, source: np.ndarray, target: np.ndarray) -> DataFrame:
    moved = {c: F.lit(float(target[i])) + sum((F.lit(float(rotation[i, j])) * (F.col(d) - float(source[j])) for j, d in enumerate("xyz")), F.lit(0.0)) for i, c in enumerate("xyz")}
    return points.withColumns(moved)

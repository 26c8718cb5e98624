"""Refusals before work, and checks that two experiments may be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import every_pair

# What each kind of work needs at least.
MINIMUM = {"records": 100, "points": 100, "actives": 20, "decoys": 10, "per_group": 5}


class RefusedError(RuntimeError):
    pass


def require_rows(df: DataFrame, what: str, least: int | None = None) -> DataFrame:
    """df, unless it has fewer rows than its kind of work needs; counts no further than that."""
    need = MINIMUM[what] if least is None else least
    have = len(df.select(F.lit(1)).take(need))
    if have < need:
        raise RefusedError(f"{have} {what}, at least {need} are needed")
    return df


def require_groups(df: DataFrame, by: str, least: int = MINIMUM["per_group"]) -> DataFrame:
    small = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < least).take(1)
    if small:
        raise RefusedError(f"group {small[0][by]!r} has {small[0]['n']} rows, at least {least} are needed")
    return df


def differing(a: DataFrame, b: DataFrame, columns: list[str]) -> list[str]:
    """Settings in which two one-row tables differ (NULL equals NULL)."""
    both = a.select(*[F.col(c).alias(f"a_{c}") for c in columns]).crossJoin(b.select(*[F.col(c).alias(f"b_{c}") for c in columns]))  # 1 x 1 rows
    row = both.select(*[(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def usable_structures(atoms: DataFrame, ligands: DataFrame, chains: DataFrame) -> DataFrame:
    """(structure_id, state): usable, no ligand, or fragment (every ligand lies on a peptide chain)."""
    on_peptide = chains.where("is_peptide").select("structure_id", "chain").withColumn("p", F.lit(True))
    per = ligands.join(on_peptide, ["structure_id", "chain"], "left").groupBy("structure_id").agg(F.count("*").alias("n"), F.count("p").alias("n_peptide"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "no ligand").when(F.col("n") == F.col("n_peptide"), "fragment").otherwise("usable")
    return atoms.select("structure_id").distinct().join(per, "structure_id", "left").select("structure_id", state.alias("state"))


def cross_pairs(receptors: DataFrame, ligands: DataFrame, transforms: DataFrame) -> DataFrame:
    """(receptor, ligand, allowed): every ordered pair, which is what is asked for; off the diagonal a trusted transform is needed.

    Ligands are broadcast up to a checked number, else dealt to blocks.
    """
    trusted = transforms.where("trusted").select("receptor", "ligand").withColumn("t", F.lit(True))
    pairs = every_pair(receptors.select(F.col("structure_id").alias("receptor")), ligands.select(F.col("structure_id").alias("ligand")))
    return pairs.join(trusted, ["receptor", "ligand"], "left").select("receptor", "ligand", ((F.col("receptor") == F.col("ligand")) | F.coalesce("t", F.lit(False))).alias("allowed"))


def cell_summary(poses: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(receptor, ligand, top_rmsd, best_rmsd, best_rank, within) of ranked poses (rank, rmsd)."""
    best = F.min(F.struct("rmsd", "rank"))
    return poses.groupBy("receptor", "ligand").agg(F.min_by("rmsd", "rank").alias("top_rmsd"), best.alias("b")).select("receptor", "ligand", "top_rmsd", F.col("b.rmsd").alias("best_rmsd"), F.col("b.rank").alias("best_rank"), (F.col("b.rmsd") < threshold).alias("within"))


def stale(allowed: DataFrame, found: DataFrame) -> DataFrame:
    """Entries of an allowlist that nothing needs any more: allowed rows that are not among the found ones, as often as they are there."""
    return allowed.exceptAll(found.select(*allowed.columns))

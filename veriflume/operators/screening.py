"""Screens: an external engine behind a plug-in contract, accounting of failures, budgets and efficiencies."""

from __future__ import annotations

import shutil
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantity import quantity
from .ranking import running_total

RESULT = "seq long, smiles string, label int, best_score double, n_heavy_atoms int, error string, elapsed double"


def engine_available(program: str = "vina") -> bool:
    """An absent engine is a state that is reported, not an error."""
    return shutil.which(program) is not None


def toolchain(spark: SparkSession) -> DataFrame:
    """(component, present, consequence) of what docking needs; an absence is a state, not an error."""
    import importlib.util

    rows = [("vina", engine_available("vina") or importlib.util.find_spec("vina") is not None, "no docking"), ("meeko", importlib.util.find_spec("meeko") is not None, "ligands are prepared by simpler rules"), ("obabel", engine_available("obabel"), "no receptor preparation")]
    return spark.createDataFrame([(n, bool(p), "" if p else c) for n, p, c in rows], "component string, present boolean, consequence string")


def screen(ligands: DataFrame, dock: Callable[[str], tuple[float | None, int | None, str | None]], budget_seconds: float | None = None) -> DataFrame:
    """Docks (seq, smiles, label) where they are; a failure is a row with its reason. The budget is each task's own: a ligand past it is a row that says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = time.monotonic()
        for pdf in batches:
            rows = []
            for seq, smiles, label in zip(pdf["seq"], pdf["smiles"], pdf["label"]):
                start = time.monotonic()
                if budget_seconds is not None and start - began > budget_seconds:
                    rows.append((seq, smiles, label, None, None, "not run: the time budget was spent", 0.0))
                    continue
                try:
                    score, atoms, error = dock(smiles)
                except Exception as problem:  # noqa: BLE001  a ligand that fails is reported like any other
                    score, atoms, error = None, None, f"{type(problem).__name__}: {problem}"
                rows.append((seq, smiles, label, score, atoms, error, time.monotonic() - start))
            yield pd.DataFrame(rows, columns=["seq", "smiles", "label", "best_score", "n_heavy_atoms", "error", "elapsed"])

    return ligands.select("seq", "smiles", "label").mapInPandas(run, RESULT)


def scored(results: DataFrame) -> DataFrame:
    """(seq, label, score) of ligands that were docked. Results without any label cannot be told apart, and are refused."""
    if results.where("label IS NOT NULL").isEmpty():
        raise ValueError("no labels: actives cannot be told from decoys")
    return results.where("error IS NULL AND best_score IS NOT NULL").select("seq", "label", F.col("best_score").alias("score"))


def pose_is_correct(rmsd: Column, limit: float = 2.0) -> Column:
    return F.coalesce(rmsd < limit, F.lit(False))


def distinguishable(a: Column, b: Column, error: float = 2.5) -> Column:
    """Whether two scores differ by more than the method's error."""
    return F.abs(a - b) > error


def attach(docked: DataFrame, properties: DataFrame, on: str = "smiles") -> DataFrame:
    """docked rows with what is known of their structures (one row each in properties), NULL where nothing is; none is lost or doubled."""
    once = properties.groupBy(on).agg(*[F.min(c).alias(c) for c in properties.columns if c != on])
    return docked.join(once, on, "left")

def missing_engine(smiles: str) -> tuple[None, None, str]:
    return None, None, "engine unavailable: no docking program on this machine"


def score_quantity(score: Column, error: float = 2.5) -> Column:
    return quantity(score, "predicted", F.lit("kcal/mol"), F.lit("docking score"), F.when(score.isNotNull(), F.lit(error)), None, F.array(F.lit("a docking score is not an affinity")))


def ligand_efficiency(score: Column, atoms: Column) -> Column:
    return F.when(atoms > 0, score / atoms)


def accounting(results: DataFrame, key: str = "label") -> DataFrame:
    """(label, n, n_failed, failure_rate)."""
    return results.groupBy(key).agg(F.count("*").alias("n"), F.count("error").alias("n_failed"), F.avg(F.col("error").isNotNull().cast("double")).alias("failure_rate"))


def failure_reasons(results: DataFrame) -> DataFrame:
    return results.where("error IS NOT NULL").groupBy(F.split("error", ":")[0].alias("reason")).agg(F.count("*").alias("n"))


def uneven_failures(results: DataFrame, limit: float = 0.1) -> DataFrame:
    return accounting(results).agg((F.max("failure_rate") - F.min("failure_rate") > limit).alias("uneven"))


def budget_prefix(df: DataFrame, budget: float, elapsed: str = "elapsed", order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Rows whose start is within the budget: what came before them, in their group if any, took no longer. Groups may be large: sums run over ranges of rows."""
    by = by or []
    total = running_total(df, [*by, order], F.coalesce(F.col(elapsed), F.lit(0)), "__s")
    if by:
        starts = total.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(F.struct(order, F.col("__s").alias("s"))).alias("__f"))
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        total = total.join(starts, on).withColumn("__s", F.col("__s") - F.col("__f.s")).drop(*[f"__{c}" for c in by], "__f")
    return total.where(F.col("__s") <= budget).drop("__s")

def pose_spread(poses: Column) -> Column:
    """(spread, determined) of an array of scores; a ranking needs two poses further apart than the method's error."""
    spread = F.array_max(poses) - F.array_min(poses)
    return F.struct(spread.alias("spread"), ((F.size(poses) > 1) & (spread > 2.5)).alias("determined"))


def poses(text: Column) -> Column:
    """Heavy-atom coordinates of each MODEL block of a pose file: array<array<struct<x, y, z>>>."""
    blocks = F.filter(F.split(text, r"(?m)^MODEL[^\n]*\n"), lambda b: F.contains(b, F.lit("ENDMDL")))

    def points(block: Column) -> Column:
        lines = F.filter(F.split(F.split(block, "ENDMDL")[0], "\n"), lambda x: F.substring(x, 1, 6).isin("ATOM  ", "HETATM") & ~F.trim(F.substring(x, 78, 2)).isin("H", "HD"))
        return F.transform(lines, lambda x: F.struct(*[F.trim(F.substring(x, 31 + 8 * i, 8)).try_cast("double").alias(c) for i, c in enumerate("xyz")]))

    return F.transform(blocks, points)

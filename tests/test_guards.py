import random

import pytest
from pyspark.sql import functions as F

from veriflume.operators import guards
from veriflume.sources import records, sinks


def test_refusals(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1)], "grp string, x int")
    assert guards.require_rows(df, "actives") is df
    with pytest.raises(guards.RefusedError):
        guards.require_rows(df, "records")
    with pytest.raises(guards.RefusedError):
        guards.require_groups(df, "grp")


def test_arms_and_cells(spark):
    a, b = (spark.createDataFrame([(x, None)], "receptor string, cpu int") for x in ("r1", "r2"))
    assert guards.differing(a, b, ["receptor", "cpu"]) == ["receptor"]
    poses = spark.createDataFrame([("r", "l", 1, 4.2), ("r", "l", 5, 1.8)], "receptor string, ligand string, rank int, rmsd double")
    r = guards.cell_summary(poses).first()
    assert (r["top_rmsd"], r["best_rmsd"], r["best_rank"], r["within"]) == (4.2, 1.8, 5, True)
    s = spark.createDataFrame([("s1",), ("s2",)], "structure_id string")
    t = spark.createDataFrame([("s1", "s2", True)], "receptor string, ligand string, trusted boolean")
    assert sum(x["allowed"] for x in guards.cross_pairs(s, s, t).collect()) == 3


def test_search_and_flush(spark, tmp_path):
    c = spark.createDataFrame([("a", ["P"], "X", 1.5), ("b", ["P"], "X", 1.2), ("c", ["Q"], "X", 1.0), ("d", ["P"], "N", 1.0)], "structure_id string, accessions array<string>, method string, resolution double")
    assert [r["structure_id"] for r in records.search(c, "P", "X", 2.0, 5).collect()] == ["b", "a"]
    for _ in range(2):  # a retried cell is there once
        records.flush(c, str(tmp_path / "cells"), "r1/l1")
    records.flush(c.limit(1), str(tmp_path / "cells"), "r1/l2")
    got = sinks.read_cells(spark, str(tmp_path / "cells"))
    assert dict(got.groupBy("cell").count().collect()) == {"r1/l1": 4, "r1/l2": 1} and sinks.finished(str(tmp_path / "cells")) == ["r1/l1", "r1/l2"]
    with pytest.raises(Exception, match="raised here"):
        records.flush(c.withColumn("structure_id", F.when(F.col("structure_id") == "d", F.raise_error(F.lit("raised here"))).otherwise(F.col("structure_id"))), str(tmp_path / "cells"), "r1/l1")
    assert sinks.read_cells(spark, str(tmp_path / "cells"), ["r1/l1"]).count() == 4  # a failed cell leaves the last one as it was
    assert not [p for p in (tmp_path / "cells" / "_staging").rglob("*") if p.is_file()]
    assert len(list((tmp_path / "cells").glob("cell-*/*.parquet"))) <= 5 and sinks.read_cells(spark, str(tmp_path / "none")) is None


def test_structure_files(spark, tmp_path):
    rows = [(s, i, f"ATOM {s} {i:5d}") for s in ("1abc", "2xyz") for i in range(300)]
    random.Random(1).shuffle(rows)
    for _ in range(2):
        sinks.write_lines(spark.createDataFrame(rows, "id string, line_no int, text string").repartition(7), str(tmp_path / "out"), "id", ["line_no"], "text", ".pdb", "END")
    assert sorted(p.name for p in (tmp_path / "out").glob("*.pdb")) == ["1abc.pdb", "2xyz.pdb"]
    assert (tmp_path / "out" / "2xyz.pdb").read_text().splitlines() == [f"ATOM 2xyz {i:5d}" for i in range(300)] + ["END"]

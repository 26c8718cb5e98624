"""Sessions: building one, and making the package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def build(app: str = "veriflume", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; conf overrides, dots written as __."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=base).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_veriflume_shipped", False):
        return
    handle, path = tempfile.mkstemp(prefix="veriflume-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(ROOT.rglob("*.py")):
            out.write(f, f"{ROOT.name}/{f.relative_to(ROOT)}")
    sc.addPyFile(path)
    sc._veriflume_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named is None:
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veriflume-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


_SCRATCH: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared scratch folder and read back: cuts lineage and recomputation. clear_scratch() deletes what was written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*dfs: DataFrame) -> None:
    """Deletes the scratch tables that cut() made for these and that nothing reads any more."""
    for df in dfs:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/stage-" in folder:
                delete(df.sparkSession, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this session: its results must have been written by then."""
    while _SCRATCH:
        delete(spark, _SCRATCH.pop())

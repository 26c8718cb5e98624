"""A Python data source that writes finished cells of an experiment, and structure files, each exactly once.

Tasks write files of their own under `_staging`; nothing reads those. The driver's commit moves the files of a cell to their place
and then replaces the cell's manifest, which is the one step that makes them count; abort deletes what was staged. A cell that is written again,
after a crash or on purpose, replaces itself, and readers follow manifests only. Paths are those of any file system that
pyarrow knows; the folder is one that the driver and all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING, MANIFESTS = "_staging", "_cells"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class _Writer(DataSourceArrowWriter):
    """Shared by both: stage files in a task, move or delete them on the driver."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.options = dict(options)

    def _stage(self) -> tuple[fs.FileSystem, str]:
        system, root = _at(self.path)
        folder = f"{root}/{STAGING}/{self.job}"
        system.create_dir(folder, recursive=True)
        return system, f"{folder}/{uuid.uuid4().hex}"  # another name for every attempt: a retried task leaves strays, not doubles

    def abort(self, messages: list) -> None:
        system, root = _at(self.path)
        folder = f"{root}/{STAGING}/{self.job}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class CellWriter(_Writer):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, sink, name = Written(), None, ""
        for batch in iterator:
            if not batch.num_rows:
                continue
            if sink is None:
                system, name = self._stage()
                sink = pq.ParquetWriter(f"{name}.parquet", batch.schema, filesystem=system)
            sink.write_batch(batch)
            out.rows += batch.num_rows
        if sink is not None:
            sink.close()
            out.files.append(f"{name}.parquet")
        return out

    def commit(self, messages: list) -> None:
        system, root = _at(self.path)
        cell = self.options["cell"]
        manifest = f"{root}/{MANIFESTS}/{_safe(cell)}.json"
        before = _manifest(system, manifest)
        files = []
        for m in messages:
            for i, staged in enumerate(m.files if m else []):
                to = f"cell-{_safe(cell)}/{self.job}-{len(files)}-{i}.parquet"
                system.create_dir(f"{root}/cell-{_safe(cell)}", recursive=True)
                system.move(staged, f"{root}/{to}")
                files.append(to)
        system.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        draft = f"{manifest}.{self.job}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"cell": cell, "files": files, "rows": sum(m.rows for m in messages if m)}).encode())
        system.move(draft, manifest)  # from here on the cell counts
        for old in (before or {}).get("files", []):
            if system.get_file_info(f"{root}/{old}").type == fs.FileType.File:
                system.delete_file(f"{root}/{old}")
        self.abort(messages)  # what failed attempts left


class LineWriter(_Writer):
    """Rows (name, line): the lines of a file come together and in order, and go to a file of that name."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, now, stream = Written(), None, None
        system = None
        for batch in iterator:
            for name, line in zip(batch.column("name").to_pylist(), batch.column("line").to_pylist()):
                if name != now:
                    if stream is not None:
                        stream.close()
                    system, staged = self._stage()
                    stream, now = system.open_output_stream(staged), name
                    out.files.append(json.dumps([staged, name]))
                stream.write(((line or "") + "\n").encode())
                out.rows += 1
        if stream is not None:
            stream.close()
        return out

    def commit(self, messages: list) -> None:
        system, root = _at(self.path)
        for m in messages:
            for pair in m.files if m else []:
                staged, name = json.loads(pair)
                system.move(staged, f"{root}/{_safe(name)}{self.options.get('suffix', '')}")
        self.abort(messages)


def _safe(name: str) -> str:
    return "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):x}" for c in str(name)) or "%"


def _manifest(system: fs.FileSystem, path: str) -> dict | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


class CellSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cells"

    def writer(self, schema, overwrite: bool) -> CellWriter:
        return CellWriter(self.options)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options)


def write_cell(rows: DataFrame, path: str, cell: str) -> None:
    """One finished cell: it is there whole or not at all, and once however often it is written."""
    spark = rows.sparkSession
    spark.dataSource.register(CellSource)
    rows.write.format("cells").mode("append").option("cell", cell).save(path)


def read_cells(spark: SparkSession, path: str, cells: list[str] | None = None) -> DataFrame | None:
    """The rows of the committed cells, with `cell`; None if there is none. Cells are few: a manifest each."""
    system, root = _at(path.rstrip("/"))
    selector = fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)
    found = [_manifest(system, info.path) for info in system.get_file_info(selector) if info.path.endswith(".json")]
    files = {f"{m['cell']}": [f"{path.rstrip('/')}/{x}" for x in m["files"]] for m in found if cells is None or m["cell"] in cells}
    out = None
    for cell, some in sorted(files.items()):
        if some:
            one = spark.read.parquet(*some).withColumn("cell", F.lit(cell))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def finished(path: str) -> list[str]:
    """The cells that need not be done again."""
    system, root = _at(path.rstrip("/"))
    return sorted(_manifest(system, i.path)["cell"] for i in system.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)) if i.path.endswith(".json"))


def write_lines(rows: DataFrame, path: str, name: str, order: list[str], line: str, suffix: str = "", end: str | None = None) -> None:
    """A file for each name, its lines in order, and a last line `end` if given. A file's lines are sorted on their way and streamed, not gathered."""
    spark = rows.sparkSession
    spark.dataSource.register(LineSource)
    keys = [F.col(c) for c in order]
    base = rows.select(F.col(name).cast("string").alias("name"), F.lit(0).alias("__last"), F.struct(*keys).alias("__k"), F.col(line).alias("line"))
    if end is not None:
        tail = rows.select(F.col(name).cast("string").alias("name")).distinct().select("name", F.lit(1).alias("__last"), F.lit(None).cast(base.schema["__k"].dataType).alias("__k"), F.lit(end).alias("line"))
        base = base.unionByName(tail)
    base.repartition("name").sortWithinPartitions("name", "__last", "__k").select("name", "line").write.format("lines").mode("append").option("suffix", suffix).save(path)

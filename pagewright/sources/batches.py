"""A folder of rows written in named batches, each of which counts once or not at all.

    register(spark)
    rows.write.format("batches").option("batch", "2024-05-31").mode("append").save("hdfs://…/results")
    stream.writeStream.format("batches").option("name", "scans").option("checkpointLocation", …).start("hdfs://…/results")
    read(spark, "hdfs://…/results")

Each task writes files of its own, named by attempt, and tells the driver their names when they are closed. When all tasks have
told, one note with the names appears in ``_batches``, in one step. Readers go by the notes, so files of killed, repeated or
given-up tasks are never read. A batch whose note is there already is not written again: a job that runs twice with
one name adds its rows once. A stream's batches are named by the option ``name`` and their numbers. With mode ``overwrite`` the note
also names the batches that it takes the place of; until it appears, those are read. Without a name, every write is a batch of its own.

Files are Parquet with ``fileRows`` (1 000 000) rows at most, or with the option ``lines`` JSON lines: of a single text column, as it
is. The driver holds one name for each file. Two jobs that write one batch at a time both end; the later note counts alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from .heads import opened

NOTES = "_batches"
Note = dict[str, object]


@dataclass
class Written(WriterCommitMessage):
    """What a task has closed."""

    files: list[str] = field(default_factory=list)
    rows: int = 0


class Batches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batches"

    def writer(self, schema: StructType, overwrite: bool) -> "BatchWriter":
        return BatchWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> "StreamWriter":
        return StreamWriter(self.options, schema, overwrite)


class _Files:
    """Writing files in tasks, and notes of them on the driver."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"], schema.json(), overwrite
        self.lines, self.file_rows = str(options.get("lines", "false")).lower() == "true", int(options.get("fileRows", 1_000_000))
        if self.lines and [type(f.dataType) for f in schema.fields] != [StringType]:
            raise ValueError("lines are written from a single column of text")
        if self.file_rows < 1:
            raise ValueError("fileRows is at least 1")

    def written(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        told, context = Written(), TaskContext.get()
        stem = f"{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        kind = "jsonl" if self.lines else "parquet"
        store.create_dir(f"{root}/rows")
        left, out = 0, None
        try:
            for batch in batches:
                while batch.num_rows:
                    if out and not left:
                        out.close()
                        out = None
                    if out is None:
                        told.files.append(f"rows/{stem}-{len(told.files)}.{kind}")
                        out, left = self._opened(store, f"{root}/{told.files[-1]}", batch.schema), self.file_rows
                    now = batch.slice(0, left)
                    self._put(out, now)
                    left, told.rows, batch = left - now.num_rows, told.rows + now.num_rows, batch.slice(now.num_rows)
            if out:
                out.close()
        except BaseException:
            _delete(store, root, told.files)
            raise
        return told

    def _opened(self, store: fs.FileSystem, path: str, schema: pa.Schema):
        return store.open_output_stream(path) if self.lines else pq.ParquetWriter(path, schema, filesystem=store)

    def _put(self, out, batch: pa.RecordBatch) -> None:
        if self.lines:
            out.write("".join(f"{x}\n" for x in batch.column(0).to_pylist() if x is not None).encode())
        else:
            out.write_batch(batch)

    def note(self, batch: str, told: list[Written]) -> None:
        store, root = opened(self.path)
        if batch in names(store, root):
            return self.dropped(told)
        note = {"schema": json.loads(self.schema), "lines": self.lines, "rows": sum(t.rows for t in told), "files": [f for t in told for f in t.files]}
        note["replaces"] = names(store, root) if self.overwrite else []
        _put_note(store, root, batch, note)

    def dropped(self, told: list[Written | None]) -> None:
        store, root = opened(self.path)
        _delete(store, root, [f for t in told if t for f in t.files])


class BatchWriter(_Files, DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        _Files.__init__(self, options, schema, overwrite)
        self.batch = checked(options.get("batch") or uuid.uuid4().hex)
        store, root = opened(self.path)
        self.there = self.batch in names(store, root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written() if self.there else self.written(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.note(self.batch, [m for m in messages if m])

    def abort(self, messages: list[Written | None]) -> None:
        self.dropped(messages)


class StreamWriter(_Files, DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        _Files.__init__(self, options, schema, overwrite)
        if "name" not in options:
            raise ValueError("a stream's batches need the option name")
        self.name = checked(options["name"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.written(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.note(f"{self.name}-{batchId}", [m for m in messages if m])

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.dropped(messages)


def checked(name: str) -> str:
    if not name or name[0] in "._" or "/" in name:
        raise ValueError(f"not a name of a batch: {name!r}")
    return name


def names(store: fs.FileSystem, root: str) -> list[str]:
    """Batches that have a note."""
    found = store.get_file_info(fs.FileSelector(f"{root}/{NOTES}", allow_not_found=True))
    return sorted(x.base_name.removesuffix(".json") for x in found if x.base_name[0] != "." and x.base_name.endswith(".json"))


def notes(folder: str) -> dict[str, Note]:
    """The notes that count, by batch: those that no other takes the place of."""
    store, root = opened(folder)
    found: dict[str, Note] = {}
    for name in names(store, root):
        with store.open_input_stream(f"{root}/{NOTES}/{name}.json") as file:
            found[name] = json.loads(file.read())
    gone = {x for note in found.values() for x in note["replaces"]}
    return {name: note for name, note in found.items() if name not in gone}


def with_totals(folder: str, batch: str, totals: dict[str, int | float]) -> dict[str, int | float]:
    """Adds totals of its rows to a batch's note, unless it has some; those it then has."""
    store, root = opened(folder)
    note = notes(folder)[batch]
    if "totals" not in note:
        note["totals"] = totals
        _put_note(store, root, batch, note)
    return note["totals"]


def _put_note(store: fs.FileSystem, root: str, batch: str, note: Note) -> None:
    """The note in one step: whole, or as it was."""
    store.create_dir(f"{root}/{NOTES}")
    hidden = f"{root}/{NOTES}/.{batch}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(json.dumps(note).encode())
    store.move(hidden, f"{root}/{NOTES}/{batch}.json")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All batches' rows, by Spark's own readers; columns that a batch doesn't have are null. Lines come as ``value``."""
    counted = list(notes(folder).values())
    if not counted:
        raise ValueError(f"no batch in {folder}")
    if len({n["lines"] for n in counted}) > 1:
        raise ValueError("lines and tables in one folder")
    paths = [f"{folder.rstrip('/')}/{f}" for n in counted for f in n["files"]]
    if counted[0]["lines"]:
        return spark.read.text(paths) if paths else spark.createDataFrame([], "value string")
    schema = StructType()
    for n in counted:
        for f in StructType.fromJson(n["schema"]).fields:
            if f.name not in schema.names:
                schema.add(f.name, f.dataType)
            elif schema[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} has two types")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def sweep(folder: str) -> int:
    """Deletes the files of no batch that counts, which killed tasks and replaced batches leave; how many. For times when nothing is written."""
    store, root = opened(folder)
    kept = {f for note in notes(folder).values() for f in note["files"]}
    left = [f"rows/{x.base_name}" for x in store.get_file_info(fs.FileSelector(f"{root}/rows", allow_not_found=True)) if f"rows/{x.base_name}" not in kept]
    _delete(store, root, left)
    return len(left)


def _delete(store: fs.FileSystem, root: str, files: list[str]) -> None:
    for name in files:
        with suppress(FileNotFoundError):
            store.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Batches)

"""Writing results."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import batches
from .heads import opened


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text; nulls are left out, as by the JSON sink."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def store_answers(answers: DataFrame, folder: str, batch: str) -> dict[str, int | float]:
    """Writes answers (with error, inference_time_ms) as a named batch of JSON lines; returns n_rows, n_errors and total_ms, which are gathered while it is written.

    Of a batch that is there already nothing is written or gathered, and the totals that its note holds are returned. An empty error is none.
    """
    batches.register(answers.sparkSession)
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    hundredths = F.sum(F.round(F.col("inference_time_ms") * 100).cast("long"))
    totals = [F.count("*").alias("n_rows"), F.count_if(failed).alias("n_errors"), (F.coalesce(hundredths, F.lit(0)) / 100).alias("total_ms")]
    note = batches.notes(folder).get(batch)
    if note:  # a driver lost between a note and its totals leaves it without them
        return note.get("totals") or batches.with_totals(folder, batch, answers.agg(*totals).first().asDict())
    seen = Observation()
    as_json(answers.observe(seen, *totals)).write.format("batches").option("lines", True).option("batch", batch).mode("append").save(folder)
    return batches.with_totals(folder, batch, seen.get)


def write_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file for each row. A file appears whole or not at all, and a task that runs twice writes the same files again."""

    def write(part: Iterator) -> None:
        store, root = opened(folder)
        attempt = TaskContext.get().taskAttemptId()
        store.create_dir(root)
        for row in part:
            hidden = f"{root}/.{row[0]}.{attempt}"
            with store.open_output_stream(hidden) as out:
                out.write(bytes(row[1]))
            store.move(hidden, f"{root}/{row[0]}")

    rows.select(name, content).foreachPartition(write)


def debug_folder(option: str | None) -> Path | None:
    """Where drawings go: the given folder, taken from the working folder if it is relative; one of a fixed name if it cannot be made; none without an option."""
    if not option:
        return None
    for folder in (Path.cwd() / option, Path.cwd() / "debug_output"):
        try:
            folder.mkdir(parents=True, exist_ok=True)
            return folder
        except OSError:
            continue
    raise OSError("no folder for drawings can be made")

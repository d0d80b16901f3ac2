"""Documents that arrive as files, through the same stateless steps as in batch.

There is no state, window or watermark here, because requests do not depend on each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..sources import batches

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, s: Settings = Settings(), files_a_trigger: int = 1000) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_trigger).load(path)
    return stream.where(f"length <= {s.max_file_mb * 1024 * 1024}")


def arriving_table(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 1000) -> DataFrame:
    """Detections or passes that other jobs write as Parquet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def write_each(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, name: str = "arrivals"):
    """Runs a batch pipeline on each micro-batch and adds its rows to a folder of named batches (`batches.read`), so a repeated batch counts once."""

    def one(batch: DataFrame, number: int) -> None:
        batches.register(batch.sparkSession)
        step(batch).write.format("batches").option("batch", f"{name}-{number}").mode("append").save(out)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Reading documents and checking uploads. One row is one document; bytes are only read where they are needed."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators.scans import ranked


def read_documents(spark: SparkSession, path: str, s: Settings = Settings(), glob: str = "*") -> DataFrame:
    """path, length, content of files up to the size limit (the limit reaches the reader, so larger files are never read). Spark skips empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where(F.col("length") <= s.max_file_mb * 1024 * 1024)


def kind(content: Column) -> Column:
    """'pdf' if the bytes start with %PDF, white space aside, else 'image'. Only bytes that start with white space are looked at as a whole."""
    first = F.hex(F.substring(content, 1, 1))
    padded = first.isin("09", "0A", "0B", "0C", "0D", "20") & F.decode(F.when(first <= "20", content), "ISO-8859-1").rlike(r"^[ \t\n\r\x0B\f]+%PDF")
    return F.when((F.hex(F.substring(content, 1, 4)) == "25504446") | padded, "pdf").otherwise("image")


def sniff(documents: DataFrame, head: str = "head") -> DataFrame:
    return documents.withColumn("kind", kind(F.col(head)))


def with_ordinal(files: DataFrame, by: str = "path", name: str = "ord") -> DataFrame:
    """Adds the place, from 0, of each row in the order of a column of distinct values, without one task that holds them all.

    Only that column is sorted, in ranges, and written to the checkpoint folder, so that numbers stay as they are when executors are lost.
    """
    placed = ranked(files.select(by), [by], name)
    return files.join(placed.withColumn(name, F.col(name) - 1), by)


def read_batch(spark: SparkSession, path: str, s: Settings = Settings(), glob: str = "*") -> DataFrame:
    """Files of a folder with their ordinals by path, which pair them with lines of ground truth."""
    return with_ordinal(read_documents(spark, path, s, glob))


def validate_uploads(uploads: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds status and reason of the first check that fails: type, size, then ground truth if there is such a column."""
    status = F.when(~F.coalesce(F.col("content_type").isin(*s.allowed_types), F.lit(False)), F.struct(F.lit(415).alias("status"), F.lit("unsupported type").alias("reason")))
    status = status.when(F.col("length") > s.max_file_mb * 1024 * 1024, F.struct(F.lit(413).alias("status"), F.lit("too large").alias("reason")))
    if "ground_truth" in uploads.columns:
        status = status.when(F.coalesce(T.blank(F.col("ground_truth")), F.lit(True)), F.struct(F.lit(422).alias("status"), F.lit("blank ground truth").alias("reason")))
    status = status.otherwise(F.struct(F.lit(200).alias("status"), F.lit("ok").alias("reason")))
    return uploads.withColumn("_s", status).select(*uploads.columns, "_s.status", "_s.reason")


def _gpu() -> str | None:
    """Name and memory of the driver's GPUs as their tool tells them; None where there is none, or no answer."""
    try:
        told = subprocess.run(["nvidia-smi", "--query-gpu=name,memory.used,memory.total", "--format=csv,noheader"], capture_output=True, text=True, timeout=5, check=True)
        return told.stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def health(spark: SparkSession, loaded: list[str]) -> DataFrame:
    """One row: status, loaded models, platform, CPU share and memory in GB (where psutil is there), and GPUs."""
    import platform

    try:
        import psutil

        cpu, ram = psutil.cpu_percent(), round(psutil.virtual_memory().used / 1e9, 2)
    except ImportError:
        cpu = ram = None
    return spark.createDataFrame([("ok", loaded, platform.platform(), cpu, ram, _gpu())], "status string, models array<string>, platform string, cpu_percent double, ram_gb double, gpu string")

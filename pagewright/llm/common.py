"""Shared helpers of the training-data operators: scratch tables, gapless ranks and Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OPEN: list["Scratch"] = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_JOINED = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that driver and executors share; they cut lineage and survive lost executors.

    The folder is ``spark.checkpoint.dir``. Only a local session may leave it unset; it then gets a temporary folder.
    The session is told, for good, to delete the shuffle files of a query when it ends: what is needed again is a table.
    """

    def __init__(self, spark: SparkSession, tag: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="pagewright-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext.getCheckpointDir()
        self.spark, self.root = spark, f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
        spark.conf.set(_CLEANED, "true")
        if not _OPEN:
            atexit.register(_close_all)
        _OPEN.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads df. A small table becomes few files: partitions are joined up to their advised size, not kept as many as there are cores."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_JOINED)
        self.spark.conf.set(_JOINED, "false")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_JOINED, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        self._delete(self.root)


def _close_all() -> None:
    for scratch in _OPEN:
        try:
            scratch.close()
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(step, schema) with small batches, as texts may be long, whose memory goes back when the task ends.

    The batch size is the session's own setting and is lowered for good: the plan may run long after this call.
    """
    df.sparkSession.conf.set(_BATCH, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives freed memory back to the system; idle Python workers would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], scratch: Scratch, name: str, rank: str = "rank") -> tuple[DataFrame, int]:
    """Adds the gapless position (from 0) in the order of ``keys``, whose last column must be unique; also gives the row count.

    One range shuffle. The sorted rows are written once, so that the offsets, one number for each partition, fit the rows read back.
    """
    n = shuffle_partitions(df.sparkSession)
    placed = scratch.save(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    counts = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    total, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    small = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p long, _offset long"))  # one row for each shuffle partition
    out = placed.withColumn("_p", F.shiftright("_at", 33)).join(small, "_p")
    return out.withColumn(rank, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_offset"), total


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's decimal text, modulo n: the folds of the held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sampled(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """At most ``size`` rows, and that many if so many differ in the columns; rows that agree in all of them count once.

    Those with the least hashes of the columns' contents are taken, so neither null nor repeated ids crowd out others. Only
    hashes are sorted, and ``size`` of them are broadcast.
    """
    draw = fresh("draw", rows)
    keyed = rows.withColumn(draw, F.xxhash64(*columns))
    least = keyed.select(draw).distinct().orderBy(draw).limit(size)
    return keyed.join(F.broadcast(least), draw).dropDuplicates([draw]).drop(draw)


#: Bits of a membership bitmap: 4 MB, whatever the data. A full bitmap lets everything pass, so only shuffles grow.
BITMAP_BITS = 1 << 25


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has. Column names are told apart without regard to case."""
    taken = {c.lower() for f in frames for c in f.columns}
    name, k = f"_{stem}", 0
    while name.lower() in taken:
        name, k = f"_{stem}{k}", k + 1
    return name


def named(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, str]:
    """df written once with a column that is unique to each row, and that column's name.

    Rows are told apart by it where ids repeat; a second reading of df itself might number them otherwise.
    """
    row = fresh("row", df)
    return scratch.save(df.withColumn(row, F.monotonically_increasing_id()), name), row


def identified(df: DataFrame, scratch: Scratch, name: str, key: str = "doc_id") -> tuple[DataFrame, str]:
    """df with a column that tells its rows apart, and that column's name: the key if none is null or repeated, else numbers."""
    ids = df.groupBy(F.col(key).cast("long").alias("id")).agg(F.count("*").alias("n"))
    worst = ids.agg(F.max("n").alias("n"), F.max(F.col("id").isNull()).alias("none")).first()
    if (worst["n"] or 0) > 1 or worst["none"]:
        return numbered(df, scratch, name)
    row = fresh("row", df)
    return df.withColumn(row, F.col(key).cast("long")), row


def marked(df: DataFrame, keys: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """df with a flag, and the flag's name: true for every row whose key is in keys, and for few others.

    The keys' hashes become a bitmap, 1024 rows of 4 KB at most, so it is safe to broadcast; it is tested before any shuffle.
    """
    flag, part, bits = (fresh(x, df) for x in ("maybe", "part", "bits"))
    slot = F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS)) + 1
    bitmap = keys.select(slot.alias("b")).groupBy(F.bitmap_bucket_number("b").alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias(bits))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn(part, F.bitmap_bucket_number(slot)).join(F.broadcast(bitmap), part, "left")
    return met.select(*named(df), F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias(flag)), flag


def maybe_in(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of df whose key may be in keys; none whose key is in keys is lost."""
    found, flag = marked(df, keys, *columns)
    return found.where(flag).drop(flag)


def without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose key is not in keys. Only rows that may be in keys are shuffled."""
    found, flag = marked(df, keys, column)
    rest = found.where(flag).drop(flag).join(keys.select(column), column, "left_anti").select(*named(df))
    return found.where(~F.col(flag)).drop(flag).unionByName(rest)

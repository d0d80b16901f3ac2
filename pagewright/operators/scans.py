"""Running sums, ranks and exact medians in a sort order, over groups of any size: no task holds more than a range of rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.window import Window

_PART = "_scan_part"


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagewright-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so lost executors cost no earlier step."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[str | Column], value: str | Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` (a whole number, not negative) over all rows up to this one in the order, this one included.

    Rows are sorted in ranges; each range is summed by itself and raised by the totals of those before it, one number a range.
    Rows that are equal in the whole order come in any order among themselves.
    """
    rows = df.withColumn(name, (F.col(value) if isinstance(value, str) else value).cast("long"))
    placed = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    at = len(df.columns)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            sums = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False)) + total
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sums, pa.int64()), pa.array(np.full(len(sums), part, dtype=np.int32))], [*batch.schema.names, _PART])

    schema = StructType([*rows.schema.fields[:at]]).add(name, LongType()).add(_PART, IntegerType())
    summed = checkpointed(placed.mapInArrow(step, schema))
    start, starts = 0, []
    for r in sorted(summed.groupBy(_PART).agg(F.max(name).alias("total")).collect()):
        starts.append((r[_PART], start))
        start += r["total"]
    small = F.broadcast(df.sparkSession.createDataFrame(starts, f"{_PART} int, _scan_start long"))  # one row for each range
    return summed.join(small, _PART).withColumn(name, F.col(name) + F.col("_scan_start")).drop(_PART, "_scan_start")


def in_ranges(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df sorted in ranges and written so, one range to a partition; adds the range's number."""
    placed = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return checkpointed(placed.withColumn(name, F.spark_partition_id()))


def ranked(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds the place, from 1, of each row in the order."""
    return running(df, order, F.lit(1), name)


def radix_median(df: DataFrame, key: list[str], value: str, small: bool = False) -> DataFrame:
    """The exact median of each key's values, integers from 0 to 2^31 - 1: key, median (the mean of the two middle ones).

    Equal values are counted once. Four rounds each settle eight bits of both middle values: values that share the bits settled so
    far are counted by their next digit, so a key's state is 256 counts, however many rows it has. Nulls are left out; a key
    without values has no row.
    ``small`` says that the keys are few enough to be broadcast.
    """
    hint = F.broadcast if small else lambda d: d
    v, k = F.col("_v"), F.col("_k")
    rows = df.select(*key, F.col(value).alias("_v")).where(v.isNotNull())
    rows = checkpointed(rows.groupBy(*key, "_v").agg(F.count("*").alias("_rows")))
    n = rows.groupBy(*key).agg(F.sum("_rows").alias("_n"))
    both = F.array(F.struct(F.lit(0).alias("_which"), F.floor((F.col("_n") - 1) / 2).cast("long").alias("_k")), F.struct(F.lit(1).alias("_which"), F.floor(F.col("_n") / 2).cast("long").alias("_k")))
    state = checkpointed(n.select(*key, F.explode(both).alias("_s")).select(*key, "_s._which", "_s._k", F.lit(0).alias("_prefix")))
    digits = Window.partitionBy(*key, "_which").orderBy("_digit")
    for shift in (24, 16, 8, 0):
        met = rows.join(hint(state), key)
        met = met.where(F.shiftright(v, shift + 8) == F.col("_prefix")) if shift < 24 else met
        counts = met.groupBy(*key, "_which", "_k", "_prefix", F.shiftright(v, shift).bitwiseAND(255).alias("_digit")).agg(F.sum("_rows").alias("_n"))
        upto = counts.withColumn("_upto", F.sum("_n").over(digits)).where("_upto > _k AND _upto - _n <= _k")  # at most 256 rows a window
        state = checkpointed(upto.select(*key, "_which", (k - F.col("_upto") + F.col("_n")).alias("_k"), (F.col("_prefix") * 256 + F.col("_digit")).cast("int").alias("_prefix")))
    return state.groupBy(*key).agg((F.sum(F.col("_prefix").cast("long")) / 2).alias("median"))

"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension (language, source, size, id) is cut into 2^bits cells at its quantiles over all rows, a row's cells give its
index on the Hilbert curve, rows are sorted by that index and the order is cut into runs. Neighbours on the curve are
neighbours in every dimension, so each shard spans few values of each and readers can skip files on any of them. Strings are
cut at their quantiles too, by the order of all their bytes.

Size and checksum are taken in one scan, and one range shuffle of small rows gives the order; texts move only when shards are
written. Ties on the curve go by document id, so one source or one group of copies spreads over as many shards as it fills.

Nulls: a null text has no bytes; a null dimension counts as the lowest cell. Rows that repeat an id are all kept (ties by
checksum and size). Other columns come back, but for those whose names the result needs; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, arrow_map, identified, ranked, shuffle_partitions

#: The columns that `shard` adds.
PLACE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of cells (n x dimensions, below 2^bits) on the Hilbert curve, by Gray-code rotation of each bit plane."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for k in range(dims):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(dims):
            index = (index << 1) | ((x[k] >> bit) & 1)
    return index


def string_bounds(df: DataFrame, column: str, cells: int, total: int) -> list[bytes]:
    """Values that cut the rows, in the order of their bytes, into cells of equal size, as near as whole values and a sixteenth of a cell allow.

    Equal values are counted map-side and range-sorted; each sorted partition tells how many rows lie up to a few of its
    values, so at most 16 * cells + partitions values reach the driver.
    """
    step = max(1, total // (16 * cells))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("binary").alias("value")).agg(F.count("*").alias("n"))
    in_order = counts.repartitionByRange(shuffle_partitions(df.sparkSession), "value").sortWithinPartitions("value")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            upto = seen + np.cumsum(batch.column(2).to_numpy())
            before = np.append(seen, upto[:-1])
            at = np.flatnonzero(upto // step != before // step)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(upto[at])], ["part", "value", "upto"])
            seen, last = int(upto[-1]), batch.slice(batch.num_rows - 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([last.column(0), last.column(1), pa.array([seen])], ["part", "value", "upto"])

    told = arrow_map(in_order.select(F.spark_partition_id().alias("part"), "value", "n"), marks, "part int, value binary, upto long").collect()
    own = {}
    for r in told:
        own[r["part"]] = max(own.get(r["part"], 0), r["upto"])
    base, part = total - sum(own.values()), None  # nulls come first
    found = [(base, b"")]
    for r in sorted(told, key=lambda r: (bytes(r["value"]), r["upto"])):
        if r["part"] != part:
            base, part = base + own.get(part, 0), r["part"]
        found.append((base + r["upto"], bytes(r["value"])))
    bounds: list[bytes] = []
    for k in range(1, cells):
        reached = next((v for upto, v in found if upto * cells >= k * total), None)
        if reached is not None and reached not in bounds[-1:]:
            bounds.append(reached)
    return bounds


def hilbert_order(df: DataFrame, dims: list[str], bits: int = 6) -> DataFrame:
    """Adds ``curve``: the Hilbert index of the columns ``dims``, numbers or strings, each quantised at its quantiles over all rows."""
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    strings = [c for c in dims if isinstance(df.schema[c].dataType, StringType)]
    numbers = [c for c in dims if c not in strings]
    found = df.agg(F.count("*").alias("rows"), *(F.percentile_approx(c, cuts, 10_000).alias(c) for c in numbers)).first()  # 2^bits numbers for each dimension
    bounds = {c: np.unique(np.array(found[c] or [], dtype=np.float64)) for c in numbers}
    for c in strings:
        values = string_bounds(df, c, 1 << bits, found["rows"])
        bounds[c] = np.empty(len(values), dtype=object)
        bounds[c][:] = values

    @F.pandas_udf("long")
    def curve(*values: pd.Series) -> pd.Series:
        cells = []
        for c, v in zip(dims, values, strict=True):
            own = v.map(lambda x: b"" if x is None else bytes(x)).to_numpy() if c in strings else v.fillna(-np.inf).to_numpy(np.float64)
            cells.append(np.searchsorted(bounds[c], own, side="left"))
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return df.withColumn("curve", curve(*(F.col(c).cast("binary" if c in strings else "double") for c in dims)))


def shard(docs: DataFrame, shards: int = 8, bits: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs with all columns and size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve."""
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    held, row = identified(docs, scratch, "rows")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = held.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    curved = hilbert_order(scratch.save(facts, "facts"), ["lang", "source", "size", "doc_id"], bits)
    order = ["curve", "doc_id", "text_crc32", "size", "row"]
    rows, total = ranked(curved.select(*order), order, scratch, "by_curve")
    at = F.floor(F.col("rank") * shards / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    places = rows.withColumn("shard", at).select(F.col("row").alias(row), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    return held.drop(*PLACE).join(places, row).drop(row)


def write_shards(docs: DataFrame, path: str, shards: int = 8, bits: int = 6, scratch: Scratch | None = None) -> None:
    """Writes the rows with all columns as Parquet, a folder for each shard, in runs of the curve, so that files can be skipped by any dimension."""
    placed = shard(docs, shards, bits, scratch).repartitionByRange(shuffle_partitions(docs.sparkSession), "shard", "slot")
    placed.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)

"""Tables laid out by a key once, so that joins on that key move no rows however often they are made.

Rows are dealt to buckets by all columns of the key and sorted by it, one file to a bucket. Two tables with the same key columns,
of the same types, and the same number of buckets are joined bucket by bucket. A bucket is read by one task: choose as many
as give about 128 MB each. A key of which one value holds many rows puts these into one bucket; for pairs by position
it is the position, which no two rows share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.scans import checkpoint_folder


def laid_out(rows: DataFrame, key: list[str], buckets: int, table: str | None = None, path: str | None = None) -> DataFrame:
    """rows as a table of the session's catalogue, laid out by the key. Without names it is a scratch table in the checkpoint folder."""
    if buckets < 1 or not key:
        raise ValueError("a layout needs a key and a bucket")
    spark = rows.sparkSession
    table = table or f"laid_out_{uuid.uuid4().hex[:12]}"
    path = path or f"{checkpoint_folder(spark)}/{table}"
    dealt = rows.repartition(buckets, *key)  # by the hash that buckets go by: each task writes one file
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, key[0], *key[1:]).sortBy(key[0], *key[1:]).mode("overwrite").saveAsTable(table)
    return spark.table(table)

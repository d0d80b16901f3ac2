"""Whole texts reach Python in batches of few bytes, however many rows there are."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagewright.functions import text as T


@F.pandas_udf(LongType())
def _sizes(s: pd.Series) -> pd.Series:
    return pd.Series([len(s)] * len(s))


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("é"), F.lit(10_000)).alias("s"))
    made = texts.select(T.nfkc(F.col("s")).alias("s"))
    assert made.where("s like 'é%'").count() == 2000
    assert texts.select(_sizes("s").alias("n")).agg(F.max("n")).first()[0] <= 400  # 40 MB in all, 20 KB a row

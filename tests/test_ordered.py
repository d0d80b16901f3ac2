"""Tables laid out by position: joins on it have no exchange."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import evaluation as E
from pagewright.plans.queries import QUERIES
from pagewright.sources.ordered import laid_out


def test_pairs_without_exchange(spark, sf):
    plan = QUERIES["paired_runs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Broadcast" not in plan, plan


def test_rows(spark, tmp_path):
    left = spark.range(200).select(F.when(F.col("id") % 50 > 0, F.col("id") % 40).alias("a"), (F.col("id") % 7).alias("b"), "id")
    right = spark.range(60).select((F.col("id") % 40).alias("a"), (F.col("id") % 7).alias("b"), F.col("id").alias("other"))
    one, two = laid_out(left, ["a", "b"], 3, "one_side", str(tmp_path / "one")), laid_out(right, ["a", "b"], 3)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 3
    met = E.pair_by_position(one.hint("merge"), two, ["a", "b"])
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, met.collect())) == sorted(map(str, E.pair_by_position(left, right, ["a", "b"]).collect()))
    assert laid_out(left.where("false"), ["a"], 2).count() == 0
    with pytest.raises(ValueError, match="bucket"):
        laid_out(left, [], 2)
    spark.sql("DROP TABLE one_side")

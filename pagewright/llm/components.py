"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for each end of the edges (a, b); a component is called by its least id.

    Each round takes the least label among neighbours and then the label of that label, so chains shorten by half; a hub
    is counted map-side, and its joins are of the kind that Spark splits. Nothing but one count a round reaches the driver.
    """
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}_both")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")), f"{name}_0")
    k = 0
    while True:
        at = labels.select(F.col("id").alias("b"), "component")
        near = both.join(at, "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "id")
        stepped = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        k += 1
        found = scratch.save(stepped.join(jump, "next").select("id", "old", F.least("next", "beyond").alias("component")), f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
        labels = found.select("id", "component")
        if found.where("old <> component").isEmpty():
            return labels

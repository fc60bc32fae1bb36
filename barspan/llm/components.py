"""Connected components of a link table by label propagation with pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import discard, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge (src, dst); component is the smallest id that links reach.

    Each round takes the smallest label among neighbours and then the label of that label, so that stars need two
    rounds and long chains about log2 of their length. Rounds are written to the shared folder, where the one before is
    removed; links and labels never come to the driver, only the count of labels that changed. Null ends are left out; an
    empty table has no components.
    """
    spark = edges.sparkSession
    given = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src is not null and dst is not null and src <> dst")
    both, both_at = written(given.unionByName(given.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels, labels_at = written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "id"), "labels")
    if labels.isEmpty():
        return labels
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "component")
        least = near.unionByName(labels).groupBy("id").agg(F.min("component").alias("low"))
        of_low = labels.select(F.col("id").alias("low"), F.col("component").alias("jump"))
        jumped = least.join(of_low, "low", "left").select("id", F.least("low", "jump").alias("component"))
        was = labels.withColumnRenamed("component", "was")
        new, new_at = written(jumped.join(was, "id"), "labels")
        discard(spark, labels_at)
        labels, labels_at = new.select("id", "component"), new_at
        if new.filter("component <> was").isEmpty():
            discard(spark, both_at)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.plans.store import drop_path, shared_path


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round takes the smallest label among a node's neighbours, then the label of that label,
    so paths halve in length. Rounds are written to the shared folder, the one before is removed.
    Nothing but a count of changed labels reaches the driver. Null ends are ignored.
    """
    spark = edges.sparkSession
    base = shared_path(spark, "components")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct().write.parquet(f"{base}/edges")
    pairs = spark.read.parquet(f"{base}/edges")
    labels = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("label"), F.lit(True).alias("changed"))
    labels.write.parquet(f"{base}/0")
    step = 0
    while True:
        now = spark.read.parquet(f"{base}/{step}").select("node", "label")
        near = (pairs.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        lower = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = now.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = lower.join(up, "label", "left").select(
            "node", F.coalesce("above", "label").alias("label"),
            (F.coalesce("above", "label") != F.col("old")).alias("changed"))
        step += 1
        new.write.parquet(f"{base}/{step}")
        drop_path(spark, f"{base}/{step - 1}")
        done = spark.read.parquet(f"{base}/{step}")
        if done.where("changed").isEmpty():
            drop_path(spark, f"{base}/edges")
            return done.select("node", F.col("label").alias("component"))

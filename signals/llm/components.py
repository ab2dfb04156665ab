"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signals.sources.scratch import write_once


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of a link table; the label is the smallest node of its component.

    Each round offers every node, and the node that is its present label, the labels across its
    links, then follows the label of the label, so long chains shorten by halves. A round is two joins, two
    combining aggregates and a table written in the shared folder; nothing is gathered but a count.
    """
    ends = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = write_once(ends.union(ends.select("y", "x")).distinct())
    labels = write_once(both.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        of_x = labels.select(F.col("node").alias("x"), F.col("label").alias("lx"))
        of_y = labels.select(F.col("node").alias("y"), F.col("label").alias("ly"))
        across = both.join(of_x, "x").join(of_y, "y").where(F.col("ly") < F.col("lx"))
        offers = across.select(F.explode(F.array("x", "lx")).alias("node"), F.col("ly").alias("label"))
        best = write_once(labels.union(offers).groupBy("node").agg(F.min("label").alias("label")))
        up = best.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = write_once(best.join(up, "label").select("node", F.least("label", "next").alias("label")))
        old = labels.withColumnRenamed("label", "old")
        if after.join(old, "node").where(F.col("label") != F.col("old")).isEmpty():
            return after
        labels = after

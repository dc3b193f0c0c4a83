"""Connected components of an edge table, by minimum labels with hooking and pointer jumping.

In every round a node takes the smallest label beside it, hands it to the node that
its own label names (so whole trees move, not single nodes), and jumps to its
label's label. Labels only fall, so the rounds end by themselves; a path's number
of rounds grows with the logarithm of its length. Every round is joins and grouped minima, written to the shared
folder, so lineage stays short and a lost executor costs a re-read. The joins
read plain tables on both sides, so a hub's many edges can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import stage


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of ``edges`` (a long, b long)."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = stage(spark, both, "cc-edges")
    labels = stage(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        nearest = both.join(known, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        told = stage(spark, labels.join(nearest, "node").select("node", "label", "near"), "cc-told")
        hooks = told.groupBy("label").agg(F.min("near").alias("hook")).withColumnRenamed("label", "node")
        better = stage(spark, told.join(hooks, "node", "left").select("node", F.least("label", "near", "hook").alias("label"), F.col("label").alias("was")), "cc-step")
        jump = better.select(F.col("node").alias("label"), F.col("label").alias("further"))
        # A label is a node, and that node's own label is at least as small.
        labels = stage(spark, better.join(jump, "label").select("node", F.least("label", "further").alias("label"), "was"), "cc-labels")
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")

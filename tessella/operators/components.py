"""Connected components by contraction, as a loop of joins over a shrinking edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import scratch, spool


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the least node of its component.

    Each round hooks every node to the least of its neighbours and itself, follows the hook twice, and contracts the
    edges to hooked nodes; edges inside a hooked group vanish, so the table shrinks from round to round and a
    component of n nodes needs about log n rounds. Hooks only lead to smaller nodes, so the last label is the least.
    Rows with a null end say nothing. Every round is written to the shared folder: lineage doesn't grow, and no node
    or edge passes through the driver.
    """
    with scratch() as keep:
        both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
        left = spool(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        n = left.count()
        nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        labels = spool(nodes.select("node", F.col("node").alias("label")), 2 * n)
        left = left.filter("a <> b")
        while not left.isEmpty():
            ends = left.select("a", "b").union(left.select("b", "a"))
            hook = spool(ends.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("to")), 2 * n)
            for _ in range(2):
                next_ = hook.select(F.col("node").alias("to"), F.col("to").alias("_next"))
                hook = hook.join(next_, "to", "left").select("node", F.coalesce("_next", "to").alias("to"))
            hook = spool(hook, 2 * n)
            labels = spool(labels.join(hook.toDF("label", "_to"), "label", "left").select("node", F.coalesce("_to", "label").alias("label")), 2 * n)
            for end in ("a", "b"):
                left = left.join(hook.toDF(end, "_to"), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
            left = spool(left.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), n)
        return keep(labels)


def conflicts(replacements: DataFrame, node: str = "node", to: str = "to") -> DataFrame:
    """[node]: nodes with several replacements, and nodes that are replaced by one that is itself replaced by another.
    A table that says who stands for whom has none."""
    told = replacements.select(F.col(node).alias("node"), F.col(to).alias("to")).filter("node <> `to`").distinct()
    several = told.groupBy("node").count().filter("count > 1").select("node")
    onward = told.join(told.select(F.col("node").alias("to")).distinct(), "to", "left_semi").select("node")
    return several.union(onward).distinct()

"""Connected components of a table of links as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.operators.storage import saved


def followed(step: DataFrame) -> DataFrame:
    """Pointers (node, to) with each target replaced by its own target, if it has one."""
    onward = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return step.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"))


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, component), the component being its smallest node; one row for each node that has a link.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by doubling, and replaces the ends of the
    links by what they point at. Links inside a tree vanish, so the graph shrinks until none is left.
    """
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        step = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        while True:
            after = saved(followed(followed(step)))
            moved = not after.join(step.withColumnRenamed("to", "was"), "node").where("to <> was").isEmpty()
            step = after
            if not moved:
                break
        found = saved(found.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("ra")), step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb")
        edges = saved(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return found

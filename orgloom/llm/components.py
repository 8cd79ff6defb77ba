"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``a, b`` edges; a component is named by its smallest node.

    Each round takes the least label among neighbours, then the label's own label, so the rounds grow with the
    logarithm of a component's width. Rounds are tables in the shared folder; nothing but a count reaches the driver.
    """
    both = stored(edges.select("a", "b").filter("a <> b").union(edges.select("b", "a").filter("a <> b")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        met = labels.join(near, "node").select("node", "component", F.least("component", "least").alias("next"))
        over = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        new = stored(met.join(over, "next").select("node", F.least("next", "beyond").alias("component"), (F.least("next", "beyond") != F.col("component")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if new.filter("changed").isEmpty():
            return labels

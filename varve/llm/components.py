"""Connected components by rounds of joins: labels fall to the smallest neighbour and then jump along their own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges(a, b)` -> `(node, label)`: `label` is the smallest node of the component. Only nodes with an edge appear.

    Each round is staged in the shared folder; the rounds grow with the logarithm of a component's length, and
    end when no label changed. Nothing but that count reaches the driver.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = stage(hooked)
        jump = hooked.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = stage(hooked.join(jump, hooked.label == jump.at).select("node", "old", F.least("label", "further").alias("label")))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")

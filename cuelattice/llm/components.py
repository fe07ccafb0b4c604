"""Connected components of an edge table, by passing on the smallest label and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the least node that it reaches.

    Each round is written out: labels spread along the edges, then each label is replaced by its own
    label, so that rounds grow with the logarithm of the longest path.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("component").alias("heard")).withColumnRenamed("b", "node")
        spread = staged(
            labels.join(heard, "node", "left")
            .select("node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("component")),
            "labels",
        )
        ends = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = staged(
            spread.join(ends, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")),
            "labels",
        )
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels

"""Connected components of an edge table by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import pin


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Each round a node takes the smallest label among its own and its neighbours', then the
    label of that label, so a chain halves in length.  Each round is a written table; the
    minimum combines before the shuffle, so a node with very many edges is no hot spot.
    """
    both = pin(
        edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        "edges",
    )
    labels = pin(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        stepped = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "component", F.least("component", "m").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = pin(
            stepped.join(jump, "next", "left").select(
                "node", F.least("next", F.coalesce("far", "next")).alias("component"),
                (F.least("next", F.coalesce("far", "next")) < F.col("component")).alias("moved"),
            ),
            "labels",
        )
        labels = step.select("node", "component")
        if step.filter("moved").isEmpty():
            return labels

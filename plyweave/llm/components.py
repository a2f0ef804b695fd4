"""Connected components of a graph given as edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyweave.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of `edges` (a long, b long).

    Each round takes the smallest label among a node's neighbours, then the label of its label, so a label travels
    twice as far each time. Rounds are written to the shared folder; only one number a round reaches the driver.
    Loops and repeated edges don't matter; rows with a null end are left out; no edges give no rows.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while before is not None:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialize(closer.join(jump, "label", "left").select("node", F.least("label", "further").alias("label")), "labels")
        now = total(labels)
        if now == before:
            break
        before = now
    return labels.select("node", F.col("label").alias("component"))

"""Connected components of links, by rounds of neighbours' minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import compact


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component): the smallest node of each component; nodes without links are left out.

    Each round a node takes the least label of itself and its neighbours, then the label of that
    label's node, so the number of rounds grows with the logarithm of a component's width. Labels
    are checkpointed to the shared folder each round, which cuts the lineage and survives lost
    executors. Nothing but the number of changes comes to the driver. A node with very many
    neighbours is no hot key: minima are taken before the shuffle.
    """
    both = compact(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct().toDF("node", "near"))
    labels = compact(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")))
    while True:
        near = both.join(labels.toDF("near", "label"), "near").groupBy("node").agg(F.min("label").alias("label"))
        took = labels.join(near, "node").select("node", F.least("component", "label").alias("next"), "component")
        jump = labels.toDF("next", "further")
        done = compact(took.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("next"), "component"))
        changed = done.where("next <> component").limit(1).count()
        labels = done.select("node", F.col("next").alias("component"))
        if not changed:
            return labels

"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfold.llm.common import keep


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), itself included.

    ``nodes`` has one column ``node``. Every round takes the smallest label of all neighbours, with
    map-side combining, and then the label of the label, so a chain shortens by half. Each round
    is a written table; it ends when a round changes nothing.
    """
    both = keep(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = keep(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        seen = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        nearer = keep(
            labels.join(seen, labels["node"] == seen["a"], "left").select(
                "node", F.least("component", F.coalesce("near", "component")).alias("component"),
                (F.coalesce("near", "component") < F.col("component")).alias("changed"),
            ),
            "nearer",
        )
        if not nearer.where("changed").limit(1).count():
            return labels
        of_label = nearer.select(F.col("node").alias("label"), F.col("component").alias("jump"))
        jumped = nearer.join(of_label, nearer["component"] == of_label["label"])
        labels = keep(jumped.select("node", F.col("jump").alias("component")), "labels")

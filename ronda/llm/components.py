"""Connected components of an edge table, without the driver holding any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ronda.llm.store import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches.

    Rounds of the smallest neighbouring label, then the label of the label.
    Each round is written to the shared folder, so that a lost executor costs
    one round at most and both sides of its joins are exchanged: a hub, or a
    label that a third of all nodes carry, is split by adaptive execution.
    Edges with a null end are no edges.  An empty table gives an empty table.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = stored(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct(),
        "links",
    )
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")), "labels")
    while True:
        met = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("met"))
        nearer = stored(
            labels.join(met, labels["node"] == met["u"], "left").select(
                "node", F.least("root", F.coalesce("met", "root")).alias("root"), F.col("root").alias("old")
            ),
            "labels",
        )
        up = nearer.select(F.col("node").alias("up"), F.col("root").alias("top"))
        labels_next = stored(
            nearer.join(up, nearer["root"] == up["up"], "left").select(
                "node", F.least("root", "top").alias("root"), "old"
            ),
            "labels",
        )
        if not labels_next.where(F.col("root") != F.col("old")).limit(1).count():
            return labels_next.select("node", "root")
        labels = labels_next.select("node", "root")

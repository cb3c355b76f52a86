"""Connected components of links, as rounds of joins; nothing is gathered in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each node of ``links`` (a, b) can reach. Nodes without links are not listed.

    Every round a node takes the least label among its own, its neighbours' and then its label's label, so labels travel
    along chains in doubling steps. Minima are combined before they are shuffled, and joins on a node with many links
    are split by adaptive execution. Each round is written to the shared folder.
    """
    both = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("least"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        new = step.join(up, step.least == up.up).select("node", F.least("least", "up_root").alias("root"), (F.least("least", "up_root") < F.col("root")).alias("moved"))
        table = materialize(new, "labels")
        discard(labels)
        labels = table
        if labels.where("moved").isEmpty():
            discard(both)
            return labels.select("node", "root")

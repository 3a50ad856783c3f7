"""Connected components of a graph that is only ever a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable from each end of ``edges`` (``a``, ``b``: long).

    Each round a node takes the smallest label around it, then its label's own
    label (pointer jumping), so the rounds follow the logarithm of the longest
    path in practice.  Labels are written to the shared folder every round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.written(both, "edges")
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        joined = labels.join(around, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("to"))
        jumped = joined.join(labels.select(F.col("node").alias("to"), F.col("root").alias("next")), "to", "left")
        fresh = common.written(jumped.select("node", F.least("to", F.coalesce("next", "to")).alias("root"), "was"), "labels")
        moved = fresh.where("root <> was").limit(1).count()
        common.delete(labels)
        labels = fresh.drop("was")
        if not moved:
            return labels

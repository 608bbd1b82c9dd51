"""Connected components of a graph whose nodes meet in buckets, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import written

MAX_ROUNDS = 200
JUMPS = 2


def bucket_components(members: DataFrame, node: str = "node", bucket: str = "bucket") -> DataFrame:
    """(node, component): a node of each component stands for all nodes that buckets connect.

    ``members`` has rows (node, bucket); an edge is a bucket of two. In each round a node takes
    the least node of all its buckets as its label, labels jump on to their own labels, and the
    labels become the nodes of the next, smaller round; buckets with one node left go. Where the
    order of nodes has nothing to do with the buckets, as with hashes, a round keeps about a
    third of the nodes at most. All steps are aggregations combined before the shuffle and
    equi-joins, which adaptive execution splits, so a bucket of any size is no single task.
    Each round's tables are written to the shared folder. Nulls in either column belong to no
    component.
    """
    members = members.select(F.col(node).alias("node"), F.col(bucket).alias("bucket"))
    current = members.where(F.col("node").isNotNull() & F.col("bucket").isNotNull())
    labels: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        least = current.groupBy("bucket").agg(F.min("node").alias("label"))
        hooks = written(current.join(least, "bucket").groupBy("node").agg(F.min("label").alias("label")), "hooks")
        for _ in range(JUMPS):
            onward = hooks.select(F.col("node").alias("label"), F.col("label").alias("onward"))
            hooks = hooks.join(onward, "label").select("node", F.col("onward").alias("label"))
        hooks = written(hooks, "hooks")
        if labels is None:
            labels = hooks
        else:
            onward = hooks.select(F.col("node").alias("label"), F.col("label").alias("onward"))
            labels = labels.join(onward, "label", "left").select("node", F.coalesce("onward", "label").alias("label"))
            labels = written(labels, "labels")
        left = current.join(hooks, "node").select(F.col("label").alias("node"), "bucket").distinct()
        shared = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
        current = written(left.join(shared, "bucket", "left_semi"), "members")
        if current.isEmpty():
            return labels.select(F.col("node").alias(node), F.col("label").alias("component"))
    raise RuntimeError(f"nodes are still not one per bucket after {MAX_ROUNDS} rounds")

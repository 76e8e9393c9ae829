"""Connected components of an edge table, by hooking and pointer jumping.

Every step is a join or an aggregate over edges; nothing is gathered on the
driver but counts. A star of any degree is done in one round, a path of n
nodes in O(log n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import written


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between different components under ``labels`` (node, root), each once."""
    one = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    two = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return ends.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node whose component holds a smaller node.

    ``edges`` has two bigint columns a and b in any order, repeats allowed.
    Nodes that are the smallest of their component, or have no edge, are absent.
    """
    labels: DataFrame | None = None
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        hook = written(current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hook")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(hook.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jump")
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hook
        else:
            over = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = written(labels.join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(hook), "labels")
        current = written(relabelled(current, hook), "contracted")
        if current.isEmpty():
            return labels

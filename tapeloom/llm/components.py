"""Connected components of an undirected graph, by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b, longs); label: the same for the nodes of a component, one of them.

    Each round every node hooks to its least neighbour, two pointer jumps shorten the paths, and edges are rewritten to
    labels; edges within a label vanish. Rounds end when none is left. Loops and repeated edges do no harm.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = edges.union(edges.select("b", "a"))
    hook = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "hook")
    labels, left = None, edges
    while True:
        for _ in range(2):
            up = hook.select(F.col("node").alias("label"), F.col("label").alias("up"))
            hook = hook.join(up, "label").select("node", F.col("up").alias("label"))
        hook = stash(hook, "jump")
        if labels is None:
            labels = hook
        else:
            labels = stash(labels.join(hook.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        for end in ("a", "b"):
            left = left.join(hook.select(F.col("node").alias(end), F.col("label").alias("up")), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        left = stash(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "left")
        if left.isEmpty():
            return labels
        both = left.union(left.select("b", "a"))
        hook = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "hook")

"""Connected components of a link table, by min-label hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for nodes that have links.

    Each round, the root of every node's tree takes the smallest root among the tree's neighbours,
    then pointers jump twice; trees at least halve in number where they can still merge, so the
    rounds grow with the logarithm of the longest path. Every round is written to the shared
    folder. Only counts reach the driver. Empty links give an empty table.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))
    labels = written(labels, "labels")
    while True:
        # smallest root seen over each link, handed to the root of the node that sees it
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooks = labels.join(near, "node").where("seen < root").groupBy(F.col("root").alias("old")).agg(F.min("seen").alias("new"))
        hooks = written(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        # hooks go to smaller roots only, so they form a forest: jump until its own roots are reached
        while True:
            up = hooks.select(F.col("old").alias("new"), F.col("new").alias("next"))
            jumped = written(hooks.join(up, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved")), "jumps")
            hooks = jumped.select("old", "new")
            if jumped.where("moved").isEmpty():
                break
        labels = written(labels.join(hooks, labels.root == hooks.old, "left").select("node", F.coalesce("new", "root").alias("root")), "labels")

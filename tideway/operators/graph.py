"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, keep) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the smallest node reachable.

    Each node takes the least node about it; these pointers are followed to
    their ends by doubling, then each group counts as one node and only edges
    between groups stay. Groups halve at least in each round, and edges are read
    only as often as there are rounds. ``keep`` cuts a step's lineage: it returns
    its argument, computed.
    """
    between = lambda rows: rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs, label = keep(between(edges)), None
    while True:
        least = pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")))
        up = keep(least.groupBy("node").agg(F.min("root").alias("root")))
        while True:
            above = up.select(F.col("node").alias("parent"), F.col("root").alias("above"))
            far = keep(up.join(above, up.root == above.parent).select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
            up = far.select("node", "root")
            if not far.where("moved").limit(1).count():
                break
        goes = up.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        label = up if label is None else keep(label.join(goes, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root")))
        left, right = up.select(F.col("node").alias("a"), F.col("root").alias("_a")), up.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        pairs = keep(between(pairs.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))))
        if not pairs.limit(1).count():
            return label

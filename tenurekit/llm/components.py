"""Connected components of an edge list, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.scratch import staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node it can reach.

    Merge joins are asked for: broadcast tables of all rounds would pile up. Each round takes the least label among a node and its neighbours, then the label of that label, so long chains
    fold up fast. Minima combine map-side; a node with very many edges is split by AQE, as both inputs of
    the join are exchanged for it. Rounds are written to the shared folder. Empty edges give no rows.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    labels = staged(labels, f"{name}-0")
    for turn in range(1, 200):
        near = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(near.hint("merge"), labels.node == near.a).select("node", F.least("root", "near").alias("hop"), F.col("root").alias("before"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        moved = nearer.join(up.hint("merge"), nearer.hop == up.up).select("node", F.least("hop", "top").alias("root"), (F.least("hop", "top") < F.col("before")).alias("moved"))
        moved = staged(moved, f"{name}-{turn}")
        labels = moved.select("node", "root")
        if not moved.where("moved").take(1):
            return labels
    raise RuntimeError("components did not settle")

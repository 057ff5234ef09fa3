"""Connected components over an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (x, y); the component is its least node.

    Each round hooks every root onto the least root next to it and then jumps pointers to their roots' roots until the
    forest is flat, so chains of length n take O(log n) rounds. Edges between nodes of one root are dropped as soon as
    they are. All steps pre-aggregate by node; a hot node is a single row of the label table. Rows with a null end and
    loops are ignored; no edges give no rows. The label table is cut to the shared folder each round.
    """
    pairs = edges.select("x", "y").where("x is not null and y is not null and x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    live = cut(pairs.distinct())
    labels = live.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        # the least neighbouring root of each root that is larger than it
        hooks = live.groupBy(F.col("y").alias("root")).agg(F.min("x").alias("to"))
        while True:
            # pointer jumping among the hooked roots alone; they shrink the table that is jumped
            far = hooks.alias("h").join(hooks.select(F.col("root").alias("to"), F.col("to").alias("beyond")), "to", "left")
            hooks = cut(far.select("root", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
            if hooks.where("moved").isEmpty():
                hooks = hooks.drop("moved")
                break
            hooks = hooks.drop("moved")
        labels = cut(
            labels.join(hooks.withColumnsRenamed({"root": "component", "to": "new"}), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        )
        moved = (
            live.join(hooks.withColumnsRenamed({"root": "x", "to": "tx"}), "x", "left")
            .join(hooks.withColumnsRenamed({"root": "y", "to": "ty"}), "y", "left")
            .select(F.coalesce("tx", "x").alias("p"), F.coalesce("ty", "y").alias("q"))
            .where("p <> q")
        )
        live = cut(moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
        if live.isEmpty():
            return labels
    raise RuntimeError("components did not settle")

"""Connected components by hooking and contraction, all in joins and grouped minima."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node that can be reached.

    edges: a, b (long, not null); loops and repeats are harmless. Each round hooks every node to its smallest neighbour,
    shortens the chains, and contracts the edges to the hooks, until none is left. Only grouped minima and joins are used,
    each join between two written tables, so a node with very many edges is split over tasks. Nothing is collected.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hooks = saved(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to")), "hooks")
        while True:  # each hook now points to the root of its chain, or to a node nearer to it
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("top"))
            hooks = saved(hooks.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"), (F.col("top") != F.col("to")).alias("moved")), "hooks")
            if hooks.where("moved").isEmpty():
                break
        hooks = hooks.select("node", "to")
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("component"))
        else:
            up = hooks.select(F.col("node").alias("component"), F.col("to").alias("top"))
            labels = saved(labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
        a, b = hooks.select(F.col("node").alias("a"), F.col("to").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        moved = saved(edges.join(a, "a").select("b", "ra"), "half")
        edges = saved(moved.join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct(), "edges")
    return edges.sparkSession.createDataFrame([], "node long, component long") if labels is None else labels

"""Connected components of an edge table by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsense.llm.scratch import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component: the smallest node reachable.

    In a round every node goes to the neighbour that comes first in a hashed order, if that is before itself, and
    on twice to where its target goes; then the edges are rewritten to the ends' targets, loops are dropped and
    equal edges made one. So each round joins the edges that are left only, and about half of the nodes go, whatever
    the ids look like. Rounds go on until no edge is left; each one's tables are written to the shared
    checkpoint folder. Loops, repeated edges and null ends are harmless; no edges give no rows.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    rest = saved(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a != b).alias("c")).where("c")
                 .select("a", "b").distinct())
    order = lambda node: F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))
    label = None
    while True:
        near = rest.union(rest.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("first"))
        goes = saved(near.select("node", F.least("first", order("node"))["node"].alias("to")))
        for _ in range(2):
            on = goes.select(F.col("node").alias("to"), F.col("to").alias("next"))
            goes = goes.join(on, "to").select("node", F.col("next").alias("to"))
        goes = saved(goes)
        label = goes if label is None else saved(
            label.join(goes.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            .select("node", F.coalesce("next", "to").alias("to")))
        for end in ("a", "b"):
            rest = rest.join(goes.select(F.col("node").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        rest = saved(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        if not rest.limit(1).count():
            break
    root = label.groupBy("to").agg(F.min("node").alias("component"))
    return label.join(root, "to").select("node", "component")

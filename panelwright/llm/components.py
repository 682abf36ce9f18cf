"""Connected components of an edge table, by contraction onto random minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that some edge names; component is the least node id reachable.

    In each round every node moves to the least of its closed neighbourhood under a hash order, the edges move
    along, and loops and repeats go; a hub's whole star closes in one round and a path of n nodes in about log n.
    Each round's edges and moves are written to the shared folder, so rounds neither recompute each other
    nor depend on the executors that ran them. Null ends and loops are ignored; no edges give an empty table.
    """
    one = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    live = stored(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = stored(nodes.select("node", F.col("node").alias("at")), "labels")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        move = both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("m")).select("v", F.least("m", rank("v")).alias("m"))
        move = stored(move.select("v", F.col("m.v").alias("to")), "moves")
        step = move.where("v <> to")
        label = stored(label.join(step, label["at"] == step["v"], "left").select("node", F.coalesce("to", "at").alias("at")), "labels")
        x = step.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        y = step.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        moved = live.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ta", "a").alias("p"), F.coalesce("tb", "b").alias("q")).where("p <> q")
        live = stored(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
    least = label.groupBy("at").agg(F.min("node").alias("component"))
    return label.join(least, "at").select("node", "component")

"""Connected components of an edge table by contraction.

Each round every node points to the neighbour (or itself) that comes first in an order, and edges are rewritten to the nodes
pointed to. The order is that of the nodes in one round, in which stars around their smallest node end at once, and drawn
anew in the next, in which a constant share of the nodes goes, whatever the shape of the graph: chains take a logarithmic number
of rounds. Every round is written to the shared folder; pointers are followed once, from the last round back, when no edge is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import store

#: Rounds whose pointers are followed in one plan.
AT_ONCE = 8


def components(edges: DataFrame, max_rounds: int = 120) -> DataFrame:
    """edges: columns a, b (long, not null). Returns node, component (smallest node reachable), for nodes that have an edge."""
    edges = store(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    pointers: list[DataFrame] = []
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        order = lambda c, turn=turn: F.struct((F.xxhash64(F.lit(turn), c) if turn % 2 else c).alias("o"), c.alias("n"))
        first = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        to = store(first.select("a", F.least("m", order(F.col("a")))["n"].alias("to")), "pointers")
        pointers.append(to)
        e = edges.join(to, "a").select(F.col("to").alias("x"), "b").join(to.withColumnRenamed("a", "b"), "b").select("x", F.col("to").alias("y"))
        edges = store(e.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))  # no rows
    ends = pointers.pop()  # of the nodes of a round: where the pointers of this and later rounds lead
    for k, to in enumerate(reversed(pointers), 1):
        ends = to.join(ends.select(F.col("a").alias("to"), F.col("to").alias("end")), "to", "left").select("a", F.coalesce("end", "to").alias("to"))
        ends = store(ends, "ends") if k % AT_ONCE == 0 else ends
    labels = store(ends.select(F.col("a").alias("node"), F.col("to").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")

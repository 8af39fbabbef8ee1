"""Connected components of an edge list, as distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for all nodes of ``edges(u, v)``; the root is the least node of the component.

    Alternating large-star and small-star steps (find and link of union-find, on all nodes at once): each step is a
    pre-aggregated minimum per node and a join, so no component has to fit in one task.  Each round is written to the shared
    folder.  Ends when every edge points at a root, after a number of rounds that grows
    with the square of the logarithm of the nodes at most.  Self-loops keep a node present.  No edges: no rows.
    """
    e = table(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null").distinct(),
        name,
    )
    while True:
        # large star: neighbours above a node move to its least neighbour
        both = e.where("u != v").select("u", "v").unionByName(e.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its lesser neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u != v").distinct()
        nxt = table(small, name)
        # done when no parent has a parent, and every node has one parent
        parents = nxt.groupBy("u").agg(F.count("*").alias("n"))
        open_ = nxt.join(parents.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() or parents.where("n > 1").limit(1).count()
        if not open_:
            nodes = nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots = nxt.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            alone = e.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root")).join(nodes.unionByName(roots), "node", "left_anti")
            return nodes.unionByName(roots).unionByName(alone)
        e = nxt.unionByName(e.where("u = v"))

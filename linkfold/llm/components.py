"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b: long); component: the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their roots by pointer jumping, and
    replaces the edges by those between roots.  A round at least halves the nodes that still have edges, and all of it
    is joins and pre-aggregated minima.  Edges with a null end and loops are left out; no edges give no rows.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "up")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored(up.join(above, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jump")
            up = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = up
        else:
            roots = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stored(found.join(roots, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "found")
        ra, rb = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(ra, "a").join(rb, "b").filter("ra != rb")
        edges = stored(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return found.select("node", F.col("root").alias("component"))

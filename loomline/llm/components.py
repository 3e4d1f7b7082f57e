"""Connected components of a link table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import Written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> Written | None:
    """Return a written table (node, component) of every node that has an edge; component is its smallest node.

    Each round hooks every node to its smallest lower neighbour, follows the pointers to their roots and
    renames the ends of the links to the roots, until no link is left. Every group is pre-aggregated
    (a minimum), every join is an equi-join that adaptive execution may split, and each round's tables are
    written to the shared folder. Self-links and nulls are dropped. Returns None for no edges.
    """
    low, high = F.least("x", "y"), F.greatest("x", "y")
    links = Written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").select(high.alias("a"), low.alias("b")).distinct(), "links")
    roots: Written | None = None
    while not links.df.isEmpty():
        hooked = Written(links.df.groupBy("a").agg(F.min("b").alias("p")), "hooked")
        while True:
            up = hooked.df.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = Written(hooked.df.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "jumped")
            moved = not jumped.df.where("moved").isEmpty()
            hooked.drop()
            hooked = jumped
            if not moved:
                break
        to = hooked.df.select("a", "p")
        if roots is None:
            ends = links.df.select(F.col("b").alias("node")).distinct().join(to, F.col("node") == F.col("a"), "left_anti")
            renewed = Written(to.select(F.col("a").alias("node"), F.col("p").alias("component")).unionByName(ends.withColumn("component", F.col("node"))), "roots")
        else:
            renewed = Written(roots.df.join(to, F.col("component") == F.col("a"), "left").select("node", F.coalesce("p", "component").alias("component")), "roots")
            roots.drop()
        roots = renewed
        left = links.df.join(to, "a", "left").select(F.col("p").alias("x"), "b")
        both = left.join(to.select(F.col("a").alias("b"), F.col("p").alias("q")), "b", "left").select("x", F.coalesce("q", "b").alias("y"))
        fewer = Written(both.where("x <> y").select(high.alias("a"), low.alias("b")).distinct(), "links")
        links.drop()
        hooked.drop()
        links = fewer
    links.drop()
    return roots

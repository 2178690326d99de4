"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexivec.plans.skew import lookup
from plexivec.plans.staging import dropped, staged

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (``a, b``), with ``comp`` the smallest node reachable.

    Each round gives a node the smallest label among its neighbours, then the label of its label, or the smallest
    that any node of its label has heard: so a label is given up as a whole, not along a path, and the
    number of rounds grows with the logarithm of the longest path (of all orders of nodes that were tried).
    Labels are a written table after every round, which replaces the one before.  Minima are combined before
    the shuffle, and both joins are lookups that spread a node with many edges and a label with many nodes.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp"), F.count("*").alias("degree"))
    labels = staged(first, "labels")
    n_nodes, n_edges, most = labels.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).first()
    if not n_nodes:
        return labels.select("node", "comp")
    for _ in range(MAX_ROUNDS):
        by_neighbour = labels.select(F.col("node").alias("b"), "comp", "degree")
        met = lookup(both, by_neighbour, ["b"], "degree", n_edges, F.xxhash64("a", "b"), "inner", most)
        heard = met.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        near = labels.join(heard, "node").select("node", "degree", F.least("comp", "heard").alias("near"), F.col("comp").alias("old"))
        near = staged(near, "near")
        sizes = near.groupBy("near").agg(F.count("*").alias("m"))
        own = labels.select(F.col("node").alias("near"), F.col("comp").alias("further"))
        given_up = near.groupBy(F.col("old").alias("near")).agg(F.min("near").alias("further"))
        jump = sizes.join(own.unionByName(given_up).groupBy("near").agg(F.min("further").alias("further")), "near")
        new = lookup(near, jump, ["near"], "m", n_nodes, F.xxhash64("node"))
        comp = F.least("near", "further")
        new = staged(new.select("node", "degree", comp.alias("comp"), (comp < F.col("old")).alias("moved")), "labels")
        dropped(labels), dropped(near)
        labels = new.drop("moved")
        if not new.filter("moved").take(1):
            return labels.select("node", "comp")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

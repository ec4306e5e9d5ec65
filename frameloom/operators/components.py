"""Connected components of a table of edges, by rounds of joins that are written between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.sources.scratch import keep, materialize, scratch_run

C = F.col


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(C("b").alias("a"), C("a").alias("b")).unionByName(edges.select("a", "b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour that is greater than a node is tied to the least node near it."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.filter("b > a").join(least.hint("merge"), "a").select(C("b").alias("a"), C("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least.hint("merge"), "a").select(C("b").alias("a"), C("m").alias("b")).filter("a <> b")
    return tied.unionByName(least.select("a", C("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): the component is its least node.

    Large and small stars alternate until all edges are stars, in some log^2 of the longest path many rounds. Each round is
    written to the shared folder, so a lost executor costs its running tasks only. A node near a third of all others is
    a row for each task in the aggregates, and its join partition is split by adaptive execution. The joins are told to merge, as
    written edges are much smaller than the nodes they would broadcast. Nulls and loops give no edge; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    with scratch_run(spark, "components"):
        now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
        seen = None
        while True:
            now = materialize(_small_star(materialize(_large_star(now), "large")), "small")
            # The sum of hashes tells whether a round has changed any edge.
            state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if state == seen:
                break
            seen = state
        nodes = now.select(C("a").alias("node"), C("b").alias("component"))
        roots = now.select(C("b").alias("node"), C("b").alias("component")).distinct()
        return keep(nodes.unionByName(roots), "components")

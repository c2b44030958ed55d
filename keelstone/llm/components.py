"""Connected components of a small-diameter link graph, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm._common import discard, materialise, spread_join


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected(links: DataFrame) -> DataFrame:
    """Label every node that has a link with the smallest node it can reach.

    ``links`` has columns ``a`` and ``b`` of one orderable type.  Returns ``node``
    and ``root``.  Alternates the large-star and small-star steps until the edge
    set stays as it is; then each node has one edge, to its root.  Their number
    grows with the logarithm of the nodes; there is no bound on it.  Self-links and
    repeated links are harmless; null ends are ignored; a node may have any share of all links.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        low = near.select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), low, ["u"], ["v"], 2 * before["n"], counts=near.select("u", "n"))
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        low = near.select("u", "m")
        small = spread_join(large, low, ["u"], ["v"], before["n"], counts=near.select("u", "n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, materialise(small, "edges")
        discard(old, large)
        state = _state(edges)
        if state == before:
            break
        before = state
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

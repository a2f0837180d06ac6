"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.session import materialize


def large_star(edges):
    """Every node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    tied = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.where("u != v").distinct()


def small_star(edges):
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    tied = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    return tied.where("u != v").distinct()


def state(edges):
    x = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return x["n"], x["h"]


def components(links):
    """``links``: u, v (long). Returns node, root for all nodes that are not their component's smallest one.

    Each round is written to the shared folder. The number of rounds grows with the logarithm of the largest component.
    """
    edges = materialize(links.where("u != v").select("u", "v").distinct(), "links")
    seen = None
    while (now := state(edges)) != seen:
        seen = now
        edges = materialize(small_star(materialize(large_star(edges), "large-star")), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

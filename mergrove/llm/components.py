"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)``; ``component`` is the smallest node reachable.

    Alternates two star contractions (each node's larger neighbours move to its smallest neighbour, then its
    smaller ones do), each a map-side-combined minimum and a join that the planner may split where a node is
    hot.  Links halve in length each round, so rounds grow with the logarithm of the longest chain.  Each
    round is a written table; the driver sees only two numbers a round.  Null ends and self-links are ignored.
    """
    edges = written(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    first = edges
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are tables of their own, so that the joins with them may be split where a node has very many links
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where(F.col("a") != F.col("b")).distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        before = edges
        edges = written(
            joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct(),
            "links",
        )
        for table in (low, large, least):
            discard(table)
        if before is not first:  # ``nodes`` reads that one
            discard(before)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == (state.n, state.h):
            break
        seen = (state.n, state.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

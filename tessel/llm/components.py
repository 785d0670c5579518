"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import discard, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): every node on an edge, with the least node that its component holds.

    Edges are undirected; loops, repeats and nulls are allowed and nulls ignored. Each round links every node to
    the least neighbour known; the rounds end when no edge changes, after about log(nodes) of them. Only minima
    are grouped (combined before the shuffle), so a node with a third of all edges costs no single task. Tables of
    earlier rounds are deleted. An empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    e = staged(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.filter("a <> b").distinct(), "large")
        discard(least, e)
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        step = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = step.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        e = staged(step.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(least, large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    out = staged(e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots), "labels")
    discard(e)
    return out

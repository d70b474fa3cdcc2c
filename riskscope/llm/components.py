"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskscope.session import materialise, release

MAX_ROUNDS = 60


def _with_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest of u and all its neighbours.

    A node of many edges is combined before the shuffle; the join back is one that adaptive
    execution can split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v here."""
    starred = _with_minimum(edges)
    kept = starred.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(starred.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge: the label is the smallest node it can reach.

    `edges` has bigint columns u and v; their order, repeats and loops do not matter. Every
    round is written to the shared folder, so no lineage grows with the rounds; the one before it goes.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialise(ordered.distinct())
    signature = None
    for _ in range(MAX_ROUNDS):
        before, current = current, materialise(_small_star(_large_star(current)))
        release(before)
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(found) == signature:
            break
        signature = tuple(found)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )

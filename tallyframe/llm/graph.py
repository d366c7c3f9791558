"""Connected components as joins: no link or label ever leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): component is the smallest id reachable over the links (a, b).

    Alternates large-star and small-star steps: each node's links are moved to its smallest neighbour, which
    halves paths, so the rounds grow with the logarithm of the longest one. Smallest neighbours come from an
    aggregate that is combined before the shuffle, so a node with many links is no hot task. Each round is
    checkpointed; a round that changes nothing ends it. Links of a node to itself and repeated links don't matter."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:  # small-star: from each node to its smaller neighbours only
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a")
        if large:
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        kept = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return kept.where("a != b").distinct()

    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    for _ in range(max_rounds):
        edges = cut(star(star(edges, True), False))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)

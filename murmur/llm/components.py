"""Connected components of an edge table by contraction: no step gathers links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import checkpoint


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: (a long, b long) -> (vertex, label), the same label for connected vertices; only vertices with edges.

    Ids should be scattered (hashes): each round hooks every vertex to its smallest neighbour and contracts, and
    among scattered ids a fixed share of the vertices goes away each round, along chains and around hubs alike.
    A round writes its own vertices and what is left of the edges; the rounds' tables are composed at the end, from
    the last and smallest to the first. Hubs meet in partial sums and in joins that Spark can split.
    """
    edges = checkpoint(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        if len(hooks) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        ways = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("e")
        hooked = edges.select(ways).select("e.*").groupBy("v").agg(F.min("n").alias("p")).select("v", F.least("v", "p").alias("p"))
        jump = hooked.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        hooked = checkpoint(hooked.join(jump, "p", "left").select("v", F.coalesce("pp", "p").alias("p")))
        hooks.append(hooked)
        left, right = hooked.select(F.col("v").alias("a"), F.col("p").alias("pa")), hooked.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").filter("pa != pb")
        # a vertex and where its parent went stay connected through the vertex's own edges
        edges = checkpoint(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not hooks:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
    labels = hooks.pop()
    while hooks:
        onward = labels.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        labels = hooks.pop().join(onward, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
    return labels.select(F.col("v").alias("vertex"), F.col("p").alias("label"))

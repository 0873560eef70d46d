"""Connected components of a graph kept in tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.plans.storage import discard, materialize


def _towards_least(edges: DataFrame, keep: str) -> DataFrame:
    """Each node's neighbours, for which ``keep`` holds, are tied to the least node around it."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = edges.join(least, "u").filter(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: the least node of its component.

    Alternates two steps until nothing changes: larger neighbours are tied to a node's least
    neighbour, then smaller ones. The number of steps grows with the logarithm of the size. Only
    the least neighbour is kept of a node's many, so no neighbourhood comes together in one task.
    """
    edges = materialize(_once(edges.select("a", "b")), "edges")
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialize(_once(_towards_least(both, "v > u")), "edges")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = materialize(_once(_towards_least(down, "v < u")), "edges")
        before, edges = edges, small
        settled = _digest(before) == _digest(edges)
        discard(before, large)
        if settled:
            labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

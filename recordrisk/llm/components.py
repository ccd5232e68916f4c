"""Connected components of a graph given as edges, by alternating star operations."""

from pyspark.sql import DataFrame, functions as F

from recordrisk.workspace import durable


def _least(edges: DataFrame) -> DataFrame:
    """For every u, the least of itself and its neighbours. Sums up on the map side, so hubs are no burden."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _stamp(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; a component is named by its least node.

    ``edges`` has long columns u and v in any direction. Large-star and small-star steps keep the edges at most as many
    as they were, and a round is written out, so a lost executor costs one step. Loops, repeated edges and nulls are dropped.
    """
    edges = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _stamp(edges)
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = durable(large)
        small = down.join(_least(down), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = durable(small.where("u <> v").distinct())
        after = _stamp(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

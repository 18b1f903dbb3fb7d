"""Connected components of an edge table by alternating star operations, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.scratch import dropped, written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``vertex, root`` for every vertex of ``edges`` (``a, b``), where root is the smallest vertex it can reach.

    Large star: the neighbours above a vertex move to the smallest of its neighbourhood. Small star: a vertex and its
    neighbours below do. Both lower the ends of edges until each component is one star; the number of rounds grows with
    the logarithm of the vertices, edges never become more than vertices and edges together. Minima come from partial
    aggregation and are written before they are joined, so a vertex with many edges isn't gathered in one task.
    """
    up = lambda df: df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(up(edges), "edges")
    state = _mark(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # as a table of its own the minima have no partitioning that the join would reuse, so Spark may split a hot vertex
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "large-least")
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where(F.col("a") != F.col("b")).distinct(), "large-star")
        dropped(least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "small-least")
        moved = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where(F.col("b") != F.col("m"))
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = written(up(small), "small-star")
        old, edges = edges, new
        dropped(old)
        dropped(large)
        dropped(least)
        if (now := _mark(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("root"))
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that are the same for the same edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

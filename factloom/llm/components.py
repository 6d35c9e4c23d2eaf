"""Connected components of an edge table, by alternating large and small stars.

Each pass hangs every node onto the smallest neighbour it knows of; stars are reached after
a number of passes that grows with the logarithm of the longest path. Passes are written
tables. Minima are pre-aggregated, and the joins on a hub are ones that adaptive execution
splits, so a component may hold a third of all nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # written: a join with a table has two plain exchanges, so a hub's edges can be split
    least = written(least, scratch(edges.sparkSession, f"{name}-least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), scratch(edges.sparkSession, f"{name}-least"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def _state(edges: DataFrame) -> tuple:
    """Same edges, same state; two hash sums make a chance match negligible."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first()
    return tuple(row)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)`` that is not its component's smallest.

    Loops and NULLs count for nothing; repeated edges count once. No edges give no rows.
    """
    spark = edges.sparkSession
    at = 0
    current = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = written(current, scratch(spark, f"{name}-{at}"))
    state = _state(current)
    while True:
        at += 1
        large = written(_large_star(current, name).distinct(), scratch(spark, f"{name}-{at}-large"))
        current = written(_small_star(large, name).distinct(), scratch(spark, f"{name}-{at}-small"))
        before, state = state, _state(current)
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))

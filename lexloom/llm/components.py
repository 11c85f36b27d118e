"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, saved_at


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component (the smallest node reachable) for each node of an edge between two nodes.

    Loops, repeated edges, either direction and null ends are allowed; an end that is null links nothing. A node with very
    many edges isn't one task's matter: minima are combined before they are shuffled and written to a table of their own,
    so that its join with the edges has an exchange that nothing else shares, which adaptive execution may split. Edge
    tables are written to the shared folder, where a lost executor can't take them away, and removed after the next round.
    """
    spark = edges.sparkSession
    found, path = saved_at(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(found)
    while state[0]:
        old = [path]
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, path = saved_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        old.append(path)
        large, path = saved_at(_large_star(both, least), "edges")
        old.append(path)
        least, path = saved_at(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        old.append(path)
        found, path = saved_at(_small_star(large, least), "edges")
        last, state = state, _state(found)
        discard(spark, *old)
        if state == last:
            break
    nodes = found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour."""
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotloom.session import stage


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``label`` (the least node reachable), for the nodes that are not their own label.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; loops, repeats and nulls do no harm. Each round hangs
    the larger neighbours of a node on its least neighbour, then the smaller ones. Every intermediate is a table in
    the shared folder, so the plan stays flat, a hub's rows can be split by an adaptive join, and a lost executor
    costs a re-read.
    """
    e = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _digest(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct())
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

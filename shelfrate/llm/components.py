"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrate.llm.common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nodes of one component share the root.

    Each round points every node at the smallest of itself and its
    neighbours, in an order drawn anew for the round, then at what that one
    points at, and replaces the ends of all edges accordingly; loops vanish,
    and the rounds end when no edge is left. With a new order each round a chain of any shape
    shrinks by a constant factor. The maps of the rounds are composed at the
    end. Every round is a written table.
    """
    edges = written(edges.select("a", "b").where(F.col("a") != F.col("b")), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.xxhash64(c, F.lit(len(maps)))  # noqa: E731,B023
        near = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("node"))).alias("low"))
        one = written(near.select(F.col("a").alias("node"), F.least(
            "low", F.struct(rank("a").alias("rank"), F.col("a").alias("node")))["node"].alias("to")), "pointers")
        step = written(one.join(one.select(F.col("node").alias("to"), F.col("to").alias("next")), "to")
                       .select("node", F.col("next").alias("to")), "contraction")
        drop_written(one)
        maps.append(step)
        ends = (edges.join(step.withColumnRenamed("node", "a").withColumnRenamed("to", "ra"), "a")
                .join(step.withColumnRenamed("node", "b").withColumnRenamed("to", "rb"), "b"))
        after = written(ends.where(F.col("ra") != F.col("rb")).select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")), "edges")
        drop_written(edges)
        edges = after
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for k, step in enumerate(maps[1:], 1):
        hop = step.select(F.col("node").alias("root"), "to")
        out = out.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if k % 4 == 0:  # plans stay small
            out = written(out, "components")
    out = written(out, "components")
    for step in maps:
        drop_written(step)
    return out

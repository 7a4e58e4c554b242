"""Dyadic nodes over integers: few rows for any range, one row a level for a point.

A node (level, node) stands for the integers from node * 2**level up to
(node + 1) * 2**level - 1. Every range is the disjoint union of at most two
nodes a level, and a point lies in one node of each level; so a range holds
a point exactly if one node of the range's cover is among the point's nodes,
and then it is exactly one. Range queries become equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shift(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level.cast("int"))


def cover(first: Column, last: Column) -> Column:
    """Nodes of the range first..last as array<struct<level, node>>; empty (or null) if there is none."""
    size = last - first + 1
    top = F.length(F.bin(F.greatest(size, F.lit(1)))) - 1  # a node is not larger than the range

    def of_level(level: Column) -> Column:
        low, high = -_shift(-first, level), _shift(last + 1, level)  # whole nodes inside: low .. high - 1
        node = lambda n: F.struct(level.cast("int").alias("level"), n.alias("node"))
        return F.array(F.when((low < high) & (low.bitwiseAND(F.lit(1)) == 1), node(low)),
                       F.when((low < high) & (high.bitwiseAND(F.lit(1)) == 1), node(high - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), of_level)), lambda n: n.isNotNull())


def nodes_of(point: Column, levels: list[int]) -> Column:
    """The point's node at each of the levels as array<struct<level, node>>."""
    return F.transform(F.array(*[F.lit(v) for v in levels]).cast("array<int>"),
                       lambda level: F.struct(level.alias("level"), _shift(point, level).alias("node")))


def levels_in(covers: DataFrame) -> list[int]:
    """The levels that occur in the column ``level`` (64 at most)."""
    return sorted(r.level for r in covers.select("level").distinct().collect())

"""Ranges by the nodes of a binary tree over whole numbers.

A range stands in the nodes of its own size that it touches, three or four at most however
long it is, and a number in one node of each size, an ancestor of its own leaf. So a range meets
the numbers near it by an equi join on nodes, each number at most once, and no range is
spelled out; what a node holds beside the range is a constant factor, left to an exact filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_nodes(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """rows with level and node, once for each node that lo to hi, both included, stands in; reversed and null ranges go."""
    level = F.floor(F.log2((hi - lo + 1).cast("double"))).cast("int")
    kept = rows.filter(lo <= hi).withColumn("level", level)
    shifted = lambda x: F.call_function("shiftright", x, F.col("level"))
    return kept.withColumn("node", F.explode(F.sequence(shifted(lo), shifted(hi))))


def levels_of(rows: DataFrame) -> list[int]:
    """The levels that nodes (column level) stand on: at most 64 numbers, whatever the rows."""
    return sorted(r["level"] for r in rows.select("level").distinct().collect())


def with_ancestors(rows: DataFrame, at: Column, levels: list[int]) -> DataFrame:
    """rows with level and node, once for each of these levels."""
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("node")) for k in levels]).cast("array<struct<level: int, node: bigint>>")
    return rows.withColumn("_d", F.explode(nodes)).withColumns({"level": F.col("_d.level"), "node": F.col("_d.node")}).drop("_d")

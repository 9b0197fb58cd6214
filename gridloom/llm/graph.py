"""Connected components by alternating large and small stars, all on DataFrames.

A round turns each node's links towards its smallest neighbour; chains shrink
by half and more.  Minima are aggregated before the shuffle and joined back
(no group is ever collected), so a node with very many links is no hot task:
the join's large partitions can be split.  Each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): v is linked to the least of u and u's neighbours; small stars look at smaller neighbours only."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
    turned = edges.join(least, F.col("u") == F.col("x"))
    if large:  # (v, m) for neighbours above u
        return turned.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.filter("x != m").select(F.col("x").alias("a"), F.col("m").alias("b"))
    return turned.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(own)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the least node that links reach, for each node with a link to another."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    down = cut(down.distinct())
    before = None
    while True:
        both = down.select(F.col("a").alias("u"), F.col("b").alias("v")).union(down.select(F.col("b").alias("u"), F.col("a").alias("v")))
        wide = _star(both, large=True).distinct()
        small = _star(cut(wide).select(F.col("a").alias("u"), F.col("b").alias("v")), large=False)
        down = cut(small.filter("a != b").distinct())
        # done when every node has one link, to a node without links downwards, and nothing moves any more
        now = down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return down.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now

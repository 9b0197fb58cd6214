"""Connected components of edge tables, by alternating stars: no task holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """image_id, node, root (the least node of its component) for each node of edges (image_id, a, b) but the roots.

    A round links every node's larger neighbours, then the others, to the least
    of them; rounds grow with the logarithm of a component's size.
    """
    keys = ["image_id", "a"]
    stars = cut(edges.filter("a != b").select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while (now := stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "a", "b").cast("decimal(38,0)"))).first()) != state:
        state = now
        both = stars.unionByName(stars.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys).agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter("b > a").join(least, keys).select("image_id", F.col("b").alias("a"), F.col("least").alias("b"))
        large = cut(large.filter("a != b").distinct())  # a > b holds
        least = large.groupBy(*keys).agg(F.min("b").alias("least"))
        small = large.join(least, keys)
        stars = small.select("image_id", F.col("b").alias("a"), F.col("least").alias("b")).unionByName(small.select("image_id", "a", F.col("least").alias("b")))
        stars = cut(stars.filter("a != b").distinct())
    return stars.select("image_id", F.col("a").alias("node"), F.col("b").alias("root"))

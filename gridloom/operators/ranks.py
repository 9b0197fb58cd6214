"""Running numbers within groups of any size.

A group of ordinary size is numbered by a window.  Where a group is larger than
a task should sort, the rows are dealt into ranges of (group, order), numbered
within each range, and moved on by what earlier ranges hold of the same group.
Only the first group of a range can have begun in an earlier one, so the
numbers to add are a row per range, however many groups there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut

#: A group of more rows is numbered in ranges.
SPREAD_FROM = 1_000_000


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str, spread_from: int = SPREAD_FROM, ranges: int | None = None) -> DataFrame:
    """rows with `name`: 1..n within each group in the given order (a long).

    The order should tell all rows of a group apart; rows that it doesn't tell
    apart get different numbers, in no fixed order.  Nulls count as a group, and
    come first in the order.  `ranges` is the number of ranges, by default that
    of shuffle partitions.
    """
    whole = Window.partitionBy(*groups).orderBy(*order)
    if rows.groupBy(*groups).count().filter(F.col("count") > spread_from).isEmpty():
        return rows.withColumn(name, F.row_number().over(whole).cast("long"))
    part = f"range_{uuid.uuid4().hex}"
    by = [*groups, *order]
    dealt = rows.repartitionByRange(*by) if ranges is None else rows.repartitionByRange(ranges, *by)
    dealt = cut(dealt.withColumn(part, F.spark_partition_id()))  # ranges come from a sample, so they are written down
    held = dealt.groupBy(part, *groups).agg(F.count(F.lit(1)).alias("n"))
    # a group's ranges follow each other; where one of its rows lies in an earlier range, the earlier counts add up
    before = F.sum("n").over(Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    moved = held.select(F.col(part).alias("at"), *[F.col(g).alias(f"g{k}") for k, g in enumerate(groups)], before.alias("before")).filter("before > 0")
    within = F.row_number().over(Window.partitionBy(part, *groups).orderBy(*order))
    same = F.col(part) == F.col("at")
    for k, g in enumerate(groups):
        same &= dealt[g].eqNullSafe(F.col(f"g{k}"))
    # a row per range at most, so it can be sent along
    names = [*rows.columns, name]
    found = dealt.withColumn(name, within.cast("long")).join(F.broadcast(moved), same, "left")
    return found.withColumn(name, F.col(name) + F.coalesce("before", F.lit(0).cast("long"))).select(*names)

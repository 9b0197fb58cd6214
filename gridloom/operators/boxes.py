"""Joins, filters and updates of box tables (image_id, box_id, x1, y1, x2, y2).

The boxes of an image of ordinary size meet each other in one join by image, so
a box is a row that moves once at most.  In a larger image pairs are found over
grids of several cell sizes.  A box lives on the finest grid whose cells are a
quarter as large as it or larger, in 25 cells at most, and looks for larger
boxes on the coarser ones in use.  A pair is made on the grid of its larger
box, in the one cell that holds its common corner.  So images with very many
boxes, of whatever sizes, cost what their overlaps cost, and need no distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import APART, HOLDS, IN, MEETS, Box, close, holds, relation, relation_strict, union_box
from ..lineage import cut
from .ranks import numbered

#: Cells of the grids: 2**n a side; still larger boxes are on a last grid of one cell for each sign of a coordinate.
LEVELS = (6, 8, 10, 12, 14, 16, 62)
SIDES = ("x1", "y1", "x2", "y2")
#: An image of more boxes is worked on over grids.
WHOLE = 256


def _own_level(reach: tuple[int, int], levels: tuple[int, ...]) -> Column:
    """The finest grid whose cells are at least a quarter as large as a box, moved out by the reach."""
    side = F.greatest(F.col("x2") - F.col("x1") + 2 * reach[0], F.col("y2") - F.col("y1") + 2 * reach[1])
    own = F.lit(levels[-1])
    for level in reversed(levels[:-1]):
        own = F.when(side <= 4 << level, level).otherwise(own)
    return own


def _cells(boxes: DataFrame, extra: list[str], reach: tuple[int, int], levels: tuple[int, ...]) -> DataFrame:
    """A row for each cell that a box, moved out by the reach, touches on its own grid (at_home) and on coarser ones, dealt by image and cell."""
    x = boxes.select("image_id", "box_id", *SIDES, *extra)
    own = _own_level(reach, levels)
    x = x.withColumn("own", own).withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda n: n >= F.col("own"))))
    size = F.pow(F.lit(2.0), F.col("level"))
    span = lambda lo, hi, r: F.sequence(F.floor((F.col(lo) - r) / size), F.floor((F.col(hi) + r) / size))
    x = x.withColumn("cx", F.explode(span("x1", "x2", reach[0]))).withColumn("cy", F.explode(span("y1", "y2", reach[1])))
    x = x.withColumn("at_home", F.col("level") == F.col("own")).drop("own")
    return x.repartition("image_id", "level", "cx", "cy")  # both sides of a join take it from here, so it is made once


def _by_size(boxes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The boxes of images of up to WHOLE boxes, and those of larger images (None if there are no such, which one count decides)."""
    large = boxes.groupBy("image_id").count().filter((F.col("count") > WHOLE) & F.col("image_id").isNotNull()).select("image_id")
    if large.isEmpty():
        return boxes, None
    large = cut(large)
    return boxes.join(large, "image_id", "left_anti"), boxes.join(large, "image_id", "left_semi")


def near_pairs(boxes: DataFrame, reach: tuple[int, int] = (0, 0), extra: list[str] = (), levels: tuple[int, ...] = LEVELS, where: Column | None = None) -> DataFrame:
    """Each pair a_box_id < b_box_id of an image whose boxes, moved out by `reach` on all sides, have a common point.

    where: a further condition on a_ and b_.  A filter of the result would do as
    well, but Spark would ask it of all pairs, before the cheap question whether
    they are near.
    """
    whole, large = _by_size(boxes)
    where = F.lit(True) if where is None else where
    pairs = _pairs_of_whole(whole, reach, list(extra), where)
    return pairs if large is None else pairs.unionByName(_pairs_over_grids(large, reach, list(extra), levels, where))


def _side(boxes: DataFrame, at: list[str], prefix: str, extra: list[str]) -> DataFrame:
    return boxes.select(*at, *[F.col(c).alias(prefix + c) for c in ("box_id", *SIDES, *extra)])


def _near(reach: tuple[int, int]) -> Column:
    """Boxes a and b, moved out by the reach, have a common point."""
    meet = lambda p, q, axis, r: F.col(f"{p}{axis}1") - 2 * r <= F.col(f"{q}{axis}2")
    return reduce(Column.__and__, [meet(p, q, axis, r) for p, q in (("a_", "b_"), ("b_", "a_"), ("a_", "a_"), ("b_", "b_")) for axis, r in zip("xy", reach)])


def _pairs_of_whole(boxes: DataFrame, reach: tuple[int, int], extra: list[str], where: Column) -> DataFrame:
    a, b = (_side(boxes, ["image_id"], p, extra) for p in ("a_", "b_"))
    return a.join(b.hint("merge"), "image_id").filter((F.col("a_box_id") < F.col("b_box_id")) & _near(reach) & where)


def _pairs_over_grids(boxes: DataFrame, reach: tuple[int, int], extra: list[str], levels: tuple[int, ...], where: Column) -> DataFrame:
    # grids on which no box lives needn't be looked at: a row per grid says which ones there are
    used = {r["own"] for r in boxes.select(_own_level(reach, levels).alias("own")).distinct().collect()}
    used = tuple(n for n in levels if n in used) or levels[:1]
    cells, at = _cells(boxes, extra, reach, used), ["image_id", "level", "cx", "cy"]
    size = F.pow(F.lit(2.0), F.col("level"))
    left, top = F.greatest("a_x1", "b_x1") - reach[0], F.greatest("a_y1", "b_y1") - reach[1]
    here = (F.floor(left / size) == F.col("cx")) & (F.floor(top / size) == F.col("cy"))

    def met(of_a: DataFrame, of_b: DataFrame) -> DataFrame:
        a, b = _side(of_a, at, "a_", extra), _side(of_b, at, "b_", extra)
        return a.join(b, at).filter((F.col("a_box_id") < F.col("b_box_id")) & _near(reach) & here & where).drop("level", "cx", "cy")

    if len(used) == 1:
        return met(cells, cells)
    # the larger box, or one of two of a grid, is at home; both may be in either place
    return met(cells, cells.filter("at_home")).unionByName(met(cells.filter("at_home"), cells.filter("NOT at_home")))


def related_pairs(boxes: DataFrame, bias: tuple[int, int] = (0, 0), extra: list[str] = (), wanted: tuple[int, ...] = (IN, HOLDS, MEETS)) -> DataFrame:
    """Pairs with their relation, less those apart or otherwise not wanted."""
    found = relation(Box.of("a_"), Box.of("b_"), bias)
    return near_pairs(boxes, bias, extra, where=found.isin(*wanted)).withColumn("relation", found)


def _with_apart(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts by image and relation; what is in no listed pair is apart."""
    n = F.count(F.lit(1))
    every = boxes.groupBy("image_id").agg((n * (n - 1) / 2).cast("long").alias("pairs"))
    counts = pairs.groupBy("image_id", "relation").agg(n.alias("n_pairs"))
    rest = every.join(counts.groupBy("image_id").agg(F.sum("n_pairs").alias("listed")), "image_id", "left")
    rest = rest.select("image_id", F.lit(APART).alias("relation"), (F.col("pairs") - F.coalesce("listed", F.lit(0))).alias("n_pairs"))
    return counts.unionByName(rest.filter("n_pairs > 0"))


def relation_counts(boxes: DataFrame, bias: tuple[int, int] = (0, 0)) -> DataFrame:
    """image_id, relation, n_pairs over all pairs of an image's boxes."""
    return _with_apart(boxes, related_pairs(boxes, bias))


def strict_relation_counts(boxes: DataFrame) -> DataFrame:
    found = relation_strict(Box.of("a_"), Box.of("b_"))
    return _with_apart(boxes, near_pairs(boxes, where=found != APART).withColumn("relation", found))


def union_by_image(boxes: DataFrame) -> DataFrame:
    """The box around all boxes of an image."""
    return boxes.groupBy("image_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def merged_pairs(boxes: DataFrame) -> DataFrame:
    """The union box of each pair that meets."""
    pairs = related_pairs(boxes, wanted=(MEETS,))
    return pairs.select("image_id", "a_box_id", "b_box_id", *union_box(Box.of("a_"), Box.of("b_")))


def translate(boxes: DataFrame, origins: DataFrame) -> DataFrame:
    """Boxes of clips into their image: moved by the clip's origin (image_id, x0, y0)."""
    x = boxes.join(origins, "image_id")
    move = {"x1": "x0", "x2": "x0", "y1": "y0", "y2": "y0"}
    return x.select("image_id", "box_id", *[(F.col(c) + F.col(move[c])).alias(c) for c in SIDES])


def pad(boxes: DataFrame, by: int, width: int, height: int) -> DataFrame:
    """Grown on all sides, kept inside the image."""
    zero = F.lit(0).cast("long")
    low = lambda c: F.greatest(F.col(c) - by, zero).alias(c)
    high = lambda c, most: F.least(F.col(c) + by, F.lit(most).cast("long")).alias(c)
    return boxes.select("image_id", "box_id", low("x1"), low("y1"), high("x2", width), high("y2", height))


def normalize(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Coordinates as parts of the image's width and height."""
    by = {"x1": width, "x2": width, "y1": height, "y2": height}
    return boxes.select("image_id", "box_id", *[(F.col(c) / F.lit(float(by[c]))).alias(f"n{c}") for c in SIDES])


def containment(boxes: DataFrame) -> DataFrame:
    """image_id, box_id, contain: sorted ids of the boxes in it; of equal boxes the later one holds the earlier."""
    a, b = Box.of("a_"), Box.of("b_")
    pairs = near_pairs(boxes, where=holds(b, a) | holds(a, b))
    outer = F.when(holds(b, a), F.col("b_box_id")).otherwise(F.col("a_box_id"))
    inner = F.when(holds(b, a), F.col("a_box_id")).otherwise(F.col("b_box_id"))
    return pairs.select("image_id", outer.alias("box_id"), inner.alias("inner")).groupBy("image_id", "box_id").agg(F.array_sort(F.collect_list("inner")).alias("contain"))


def drop_contained(boxes: DataFrame) -> DataFrame:
    """Boxes in no other box that isn't a Block (column category); of equal boxes the earlier goes."""
    whole, large = _by_size(boxes)
    other, ids = Box.of("b_"), (F.col("box_id"), F.col("b_box_id"))
    later = (ids[0] < ids[1]) | (ids[0] > ids[1]) & ~holds(Box.of(), other)
    keeps = F.when(ids[0] != ids[1], F.col("b_category") == "Block")  # asked of pairs, so both sides are read as the same rows
    kept = whole.join(_side(whole, ["image_id"], "b_", ["category"]).hint("merge").withColumnRenamed("image_id", "b_image_id"), (F.col("image_id") == F.col("b_image_id")) & holds(other, Box.of()) & later & ~keeps, "left_anti")
    if large is None:
        return kept
    a, b = Box.of("a_"), Box.of("b_")
    inside_b = holds(b, a) & (F.col("b_category") != "Block")
    inside_a = holds(a, b) & ~holds(b, a) & (F.col("a_category") != "Block")
    pairs = _pairs_over_grids(large, (0, 0), ["category"], LEVELS, inside_a | inside_b)
    gone = pairs.select("image_id", F.when(inside_b, F.col("a_box_id")).otherwise(F.col("b_box_id")).alias("box_id"))
    return kept.unionByName(large.join(gone, ["image_id", "box_id"], "left_anti"))


def close_pairs(boxes: DataFrame, distance: int = 20) -> DataFrame:
    """Pairs in the same rows whose facing sides are nearer than the distance."""
    pairs = near_pairs(boxes, (distance // 2 + 1, 0), where=close(Box.of("a_"), Box.of("b_"), distance))
    return pairs.select("image_id", "a_box_id", "b_box_id")


def keep_plausible(boxes: DataFrame, min_area: int, image_height: int) -> DataFrame:
    """Boxes (with width, height) that are large enough, not too tall, and neither too flat nor too thin."""
    w, h = F.col("width"), F.col("height")
    thin = (F.least(w, h) < 8) & ((w > 10 * h) | (h > 10 * w))
    return boxes.filter((w * h >= min_area) & (10 * h <= 8 * F.lit(image_height)) & (w <= 50 * h) & (h <= 40 * w) & ~thin)


def drop_bars(boxes: DataFrame, image_height: int, top: float = 0.045, bottom: float = 0.94) -> DataFrame:
    """Without boxes that end above the top bar's or begin below the bottom bar's line."""
    return boxes.filter(~((F.col("y2") < image_height * top) | (F.col("y1") > image_height * bottom)))


def number(boxes: DataFrame, order: list[str]) -> DataFrame:
    """Ids 1..n within an image in the given order."""
    return numbered(boxes, ["image_id"], order, "nth").withColumn("nth", F.col("nth").cast("int"))


def drop_noise(boxes: DataFrame) -> DataFrame:
    return boxes.filter(F.col("category") != "Noise")


def drop_inside_images(boxes: DataFrame) -> DataFrame:
    """Without boxes that an Image box lists in its `contain` (ids)."""
    listed = boxes.filter(F.col("category") == "Image").select("image_id", F.explode("contain").alias("box_id")).distinct()
    return boxes.join(listed, ["image_id", "box_id"], "left_anti")


def sizes(boxes: DataFrame) -> DataFrame:
    """With width, height and area as distances of the corners, as after a merge."""
    x = boxes.withColumn("width", F.col("x2") - F.col("x1")).withColumn("height", F.col("y2") - F.col("y1"))
    return x.withColumn("area", F.col("width") * F.col("height"))


def numbered_clippings(boxes: DataFrame) -> DataFrame:
    """With nth: a running index within (image_id, category), as clippings are named."""
    return numbered(boxes, ["image_id", "category"], ["box_id"], "nth").withColumn("nth", F.col("nth").cast("int"))

"""Operators on pixel tables (image_id, y, x, v), one row per pixel.

Pixels are dealt by image once; windows along rows and along columns then
need no further exchange, as each image is whole in its partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels

#: Frames of up to so many pixels are taken pixel by pixel; larger ones by blocks or by histograms.
SMALL = 5
_PIXELS = pa.schema([(n, pa.int64()) for n in ("image_id", "y", "x", "v")])


def along_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def by_image(pixels: DataFrame) -> DataFrame:
    return pixels.repartition("image_id")


def gray(pixels: DataFrame) -> DataFrame:
    """(b, g, r) -> v = 0.299 r + 0.587 g + 0.114 b, rounded, in integers."""
    v = F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b") + 500) / 1000)
    return pixels.select("image_id", "y", "x", v.cast("long").alias("v"))


def gradient(pixels: DataFrame, saturate: bool = False) -> DataFrame:
    """|right - v| + |below - v|; the last column and row take the pixel before; wrapped at 256, or kept at 255."""
    step = lambda w: F.abs(F.coalesce(F.lead("v").over(w), F.lag("v").over(w), F.col("v")) - F.col("v"))
    g = step(along_row()) + step(along_column())
    g = F.least(g, F.lit(255)) if saturate else g % 256
    return by_image(pixels).withColumn("g", g).select("image_id", "y", "x", F.col("g").alias("v"))


def threshold(pixels: DataFrame, above: int = 10) -> DataFrame:
    return pixels.withColumn("v", F.when(F.col("v") > above, 255).otherwise(0))


def invert(pixels: DataFrame) -> DataFrame:
    """255 where v is 0 or 1, else 0."""
    return pixels.withColumn("v", F.when(F.col("v") <= 1, 255).otherwise(0))


def close_gaps(pixels: DataFrame, kernel: tuple[int, int] = (2, 1)) -> DataFrame:
    """Dilate, then erode, with a rows x columns kernel anchored at half its size; nothing outside the image counts."""
    x = by_image(pixels)
    for pick in (F.max, F.min):
        for size, along in zip(kernel, ("y", "x")):
            if size > SMALL:
                x = _extremes_by_blocks(x, pick, size, along)
            elif size > 1:
                anchor, window = size // 2, along_column() if along == "y" else along_row()
                x = x.withColumn("v", pick("v").over(window.rowsBetween(-anchor, size - 1 - anchor)))
    return x


def _extremes_by_blocks(pixels: DataFrame, pick, size: int, along: str) -> DataFrame:
    """v: the extreme of a frame of `size` pixels anchored at half of it, at a cost that doesn't grow with the size.

    Lines are cut into blocks of `size`; a frame is the end of a block and the
    beginning of the next, so running extremes from both ends of each block do.
    """
    anchor, line = size // 2, ["image_id", "x" if along == "y" else "y"]
    whole = Window.partitionBy(*line).orderBy(along)
    block = Window.partitionBy(*line, "block").rowsBetween(Window.unboundedPreceding, 0)
    x = pixels.withColumn("nth", F.row_number().over(whole) - 1).withColumn("block", F.floor(F.col("nth") / size))
    x = x.withColumn("ahead", pick("v").over(block.orderBy(along))).withColumn("back", pick("v").over(block.orderBy(F.desc(along))))
    # the line's last pixel stands for those behind it, unless its block is the one that the frame begins in
    last = Window.partitionBy(*line).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("end", F.last(F.struct("block", "ahead")).over(last))
    first_block, begins = F.lag("block", anchor).over(whole), F.lag("back", anchor).over(whole)
    ends = F.lead("ahead", size - 1 - anchor).over(whole)
    ends = F.when(ends.isNotNull(), ends).when(first_block.isNull() | (F.col("end.block") > first_block), F.col("end.ahead"))
    combined = F.greatest(begins, ends) if pick is F.max else F.least(begins, ends)
    return x.withColumn("found", combined).withColumn("v", F.col("found")).select(*pixels.columns)


def valid_rows(pixels: DataFrame, gap: int = 5, share: float = 0.95) -> DataFrame:
    """image_id, y, valid: set pixels on more than the share of the row, without an inner gap over the limit."""
    on = pixels.withColumn("on", F.when(F.col("v") > 0, F.col("x")))
    before = F.max("on").over(along_row().rowsBetween(Window.unboundedPreceding, -1))
    hole = F.col("on") - before - 1
    rows = by_image(on).withColumn("hole", hole).groupBy("image_id", "y").agg(F.count("on").alias("n_on"), F.max("hole").alias("hole"), F.count(F.lit(1)).alias("width"))
    return rows.select("image_id", "y", ((F.col("n_on") > share * F.col("width")) & (F.coalesce("hole", F.lit(0)) <= gap)).alias("valid"))


def thin_bands(rows: DataFrame, thickness: int = 8) -> DataFrame:
    """image_id, y0, y1 of the runs of valid rows that are thinner than the limit."""
    w = Window.partitionBy("image_id").orderBy("y")
    runs = rows.withColumn("nth", F.row_number().over(w)).filter("valid")
    runs = runs.withColumn("run", F.col("y") - F.row_number().over(w)).groupBy("image_id", "run").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    return runs.filter(F.col("y1") - F.col("y0") + 1 < thickness).select("image_id", "y0", "y1")


def _blank(pixels: DataFrame, bands: DataFrame) -> DataFrame:
    """v = 0 on the rows of the bands."""
    rows = bands.select("image_id", F.explode(F.sequence("y0", "y1")).alias("y")).withColumn("gone", F.lit(True))
    return pixels.join(rows.distinct(), ["image_id", "y"], "left").withColumn("v", F.when(F.col("gone"), 0).otherwise(F.col("v"))).select("image_id", "y", "x", "v")


def erase_lines_simple(pixels: DataFrame, thickness: int = 8) -> DataFrame:
    """Without the pixels of all thin bands of line rows, wherever they lie."""
    return _blank(pixels, thin_bands(valid_rows(pixels), thickness))


def runs(rows: DataFrame) -> DataFrame:
    """image_id, n (rows), runs array<struct<a, b>> of valid rows, in order, b exclusive."""
    w = Window.partitionBy("image_id").orderBy("y")
    x = rows.withColumn("nth", F.row_number().over(w)).withColumn("run", F.col("nth") - F.sum(F.col("valid").cast("int")).over(w))
    x = x.groupBy("image_id", "run").agg(F.min(F.when(F.col("valid"), F.col("y"))).alias("a"), (F.max(F.when(F.col("valid"), F.col("y"))) + 1).alias("b"), F.max("y").alias("last"))
    found = F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b"))))
    return x.groupBy("image_id").agg((F.max("last") + 1).alias("n"), found.alias("runs"))


def line_erasures(runs: Column, n: Column, thickness: int = 8) -> Column:
    """kernels.line_erasures over an array of runs: array<struct<y0, y1>>, y1 inclusive."""
    none = F.array().cast("array<struct<y0:bigint,y1:bigint>>")
    behind = F.concat(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")))
    pairs = F.zip_with(runs, behind, lambda r, c: F.struct(r["a"].alias("a"), r["b"].alias("b"), c["a"].alias("c"), c["b"].alias("d")))
    state = F.struct(F.lit(0).cast("long").alias("from_row"), none.alias("out"))

    def step(s, r):
        a, room = F.greatest(r["a"], s["from_row"]), r["b"] + thickness + 1
        thin = (a < r["b"]) & (r["b"] < a + thickness)
        alone = r["c"].isNull() | (r["c"] > room)
        gone = F.when(thin & (r["b"] == n), F.struct(a.alias("y0"), (n - 2).alias("y1"))).when(thin & alone, F.struct(a.alias("y0"), (r["b"] - 1).alias("y1")))
        taken_in = thin & ~alone & (r["b"] < n) & ((r["d"] > room) | (r["d"] == n))
        from_row = F.when(taken_in, F.least(room + 1, n)).otherwise(s["from_row"])
        return F.struct(from_row.alias("from_row"), F.when(gone.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(gone))).alias("out"))

    return F.filter(F.aggregate(pairs, state, step, lambda s: s["out"]), lambda b: b["y0"] <= b["y1"])


def erase_lines(pixels: DataFrame, thickness: int = 8) -> DataFrame:
    """Without thin horizontal lines that have room behind them (rows are numbered from 0 without holes)."""
    found = runs(valid_rows(pixels))
    return _blank(pixels, found.select("image_id", F.inline(line_erasures(F.col("runs"), F.col("n"), thickness))))


def _first_runs(pixels: DataFrame, along: str, across: str, share: float) -> DataFrame:
    """image_id, line, lo, hi: of each line of pixels the first solid run over the share of its length."""
    window = Window.partitionBy("image_id", across).orderBy(along)
    edge = pixels.groupBy("image_id").agg((F.max(along) + 1).alias("edge"))
    runs = by_image(pixels.filter("v > 0")).withColumn("run", F.col(along) - F.row_number().over(window))
    runs = runs.groupBy("image_id", across, "run").agg(F.min(along).alias("lo"), F.max(along).alias("hi")).join(edge, "image_id")
    long = runs.filter(F.col("hi") - F.col("lo") + 1 > share * F.col("edge"))
    return long.groupBy("image_id", F.col(across).alias("line")).agg(F.min(F.struct("lo", "hi")).alias("r")).select("image_id", "line", "r.lo", "r.hi")


def _bands(lines: DataFrame, ends: DataFrame, thickness: int) -> DataFrame:
    """The lines in bands thinner than the limit that another line follows."""
    w = Window.partitionBy("image_id").orderBy("line")
    x = lines.withColumn("band", F.col("line") - F.row_number().over(w))
    band = Window.partitionBy("image_id", "band")
    x = x.withColumn("n", F.count(F.lit(1)).over(band)).withColumn("last", F.max("line").over(band)).join(ends, "image_id")
    return x.filter((F.col("n") < thickness) & (F.col("last") < F.col("end"))).select("image_id", "line", "lo", "hi")


def erase_lines_both(pixels: DataFrame, thickness: int = 8, share: float = 0.6) -> DataFrame:
    """Without thin bands of solid lines: of rows the run itself, of columns the whole column."""
    ends = pixels.groupBy("image_id").agg(F.max("y").alias("ey"), F.max("x").alias("ex"))
    rows = _bands(_first_runs(pixels, "x", "y", share), ends.select("image_id", F.col("ey").alias("end")), thickness)
    columns = _bands(_first_runs(pixels, "y", "x", share), ends.select("image_id", F.col("ex").alias("end")), thickness)
    x = pixels.join(rows.select("image_id", F.col("line").alias("y"), "lo", "hi"), ["image_id", "y"], "left")
    x = x.join(columns.select("image_id", F.col("line").alias("x"), F.lit(True).alias("gone")), ["image_id", "x"], "left")
    gone = F.coalesce(F.col("x").between(F.col("lo"), F.col("hi")), F.lit(False)) | F.coalesce("gone", F.lit(False))
    return x.select("image_id", "y", "x", F.when(gone, 0).otherwise(F.col("v")).alias("v"))


def median(pixels: DataFrame, size: int = 3, tile: int = 512) -> DataFrame:
    """The median of the size x size square around each pixel (size odd), the border repeated outwards.

    Squares of up to SMALL are sorted in the JVM.  For larger ones a task takes
    a tile of a whole, rectangular image with the pixels around it, and slides
    histograms over it, so the cost hardly grows with the size.
    """
    if size > SMALL:
        return _median_by_tiles(pixels, size, tile)
    reach = size // 2
    x = by_image(pixels).select("image_id", "y", "x", "v")
    for name, window in (("v", along_row()), ("across", along_column())):
        ends = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(name).over(ends), F.last(name).over(ends)
        shifted = [F.coalesce(F.lag(name, -d).over(window), first if d < 0 else last) for d in range(-reach, reach + 1)]
        x = x.withColumn("across", F.array(*shifted)) if name == "v" else x.withColumn("square", F.flatten(F.array(*shifted)))
    return x.select("image_id", "y", "x", F.array_sort("square")[size * size // 2].alias("v"))


def _median_by_tiles(pixels: DataFrame, size: int, tile: int) -> DataFrame:
    reach = size // 2
    x = pixels.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "y", "x", "v")])
    for at, of in (("ty", "y"), ("tx", "x")):
        x = x.withColumn(at, F.explode(F.sequence(F.floor((F.col(of) - reach) / tile), F.floor((F.col(of) + reach) / tile))))

    def run(table: pa.Table) -> pa.Table:
        y, x, v = (table[c].to_numpy() for c in ("y", "x", "v"))
        y0, x0, top, left = y.min(), x.min(), table["ty"][0].as_py() * tile, table["tx"][0].as_py() * tile
        a = np.zeros((int(y.max() - y0) + 1, int(x.max() - x0) + 1), np.int64)
        a[y - y0, x - x0] = v
        # the tile's own rows and columns that the image has; what a square lacks there is beyond the image's border
        own = [(max(lo, first), min(lo + tile, first + n)) for lo, first, n in ((top, int(y0), a.shape[0]), (left, int(x0), a.shape[1]))]
        if any(lo >= hi for lo, hi in own):
            return _PIXELS.empty_table()
        lack = [(max(0, first - lo + reach), max(0, hi + reach - first - n)) for (lo, hi), first, n in zip(own, (int(y0), int(x0)), a.shape)]
        from_row, from_col = (max(0, lo - reach - first) for (lo, _), first in zip(own, (int(y0), int(x0))))
        found = kernels.inner_median(np.pad(a, lack, mode="edge")[from_row:, from_col:], size)
        ys, xs = np.mgrid[own[0][0] : own[0][1], own[1][0] : own[1][1]]
        found = found[: ys.shape[0], : ys.shape[1]]
        return pa.table([pa.array(np.full(found.size, table["image_id"][0].as_py())), ys.ravel(), xs.ravel(), found.ravel()], schema=_PIXELS)

    return x.groupBy("image_id", "ty", "tx").applyInArrow(run, "image_id long, y long, x long, v long")


def clip(pixels: DataFrame, boxes: DataFrame, margin: int = 0) -> DataFrame:
    """The pixels of each box, grown by a margin; as slices go, the last row and column are not in it.

    A box meets the pixels row by row, so a join's key is a row of an image, not the image.
    """
    rows = F.sequence(F.col("y1") - margin, F.col("y2") + margin - 1)
    b = boxes.filter(F.col("y2") - F.col("y1") + 2 * margin > 0).select("image_id", "box_id", F.explode(rows).alias("y"), (F.col("x1") - margin).alias("lo"), (F.col("x2") + margin).alias("hi"))
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))
    return pixels.join(b, ["image_id", "y"]).filter(inside).select("image_id", "box_id", "y", "x", "v")

"""plans.detect as a plan of tables of tiles, regions and boxes, whose rows grow with tiles and regions, not with pixels.

An image is cut into tiles, each a row with its gray values and its binary map.
Regions are labelled by tile, a row each, and united across borders by joins of
their edges; measures are aggregates; clips and the lines of blocks are joins of
tiles and boxes.  Only the two merges take an image's boxes, and the folds along
borders a region's, as one row.  Regions are known by their first seed, which
orders them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import boxes, kernels, merging, regions
from ..sources.images import array
from . import detect as whole
from .detect import Params

SIDES = boxes.SIDES
#: Side of the tiles in which regions are labelled and clips are found.
TILE = 1024
_TILES = pa.schema([("image_id", pa.int64()), *((n, pa.int32()) for n in ("ih", "iw", "ty", "tx", "h", "w")), ("gray", pa.binary()), ("bits", pa.binary())])


def tiles(images: DataFrame, p: Params = Params(), tile: int = TILE) -> DataFrame:
    """image_id, ih, iw (the image's height and width), ty, tx, h, w, gray (a byte a pixel), bits (the binary map without lines, a bit a pixel)."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                v = whole.gray(array(r["data"], r["height"], r["width"], r["channels"]))
                on = kernels.erase_lines(kernels.close_gaps(kernels.gradient(v, p.saturate) > p.min_grad, p.kernel))
                for ty in range(0, v.shape[0], tile):
                    rows = []
                    for tx in range(0, v.shape[1], tile):
                        g, b = v[ty : ty + tile, tx : tx + tile], on[ty : ty + tile, tx : tx + tile]
                        rows.append((r["image_id"], *v.shape, ty // tile, tx // tile, *g.shape, g.astype(np.uint8).tobytes(), np.packbits(b).tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TILES.types)], schema=_TILES)

    rows = images.select(F.col("image_id").cast("long").alias("image_id"), "height", "width", "channels", "data")
    return rows.mapInArrow(run, "image_id long, ih int, iw int, ty int, tx int, h int, w int, gray binary, bits binary")


def _bits(row: dict) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=row["h"] * row["w"]).reshape(row["h"], row["w"]).astype(bool)


def _map_tiles(rows: DataFrame, of, keys: list[str], made: str) -> DataFrame:
    """The keys, and the columns that `of` makes, a row of tiles at a time."""
    types = dict(rows.dtypes)
    names = [*keys, *(x.split(" ")[0] for x in made.split(", "))]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                columns = of(one.to_pylist()[0])
                repeated = [one[c].take(pa.array(np.zeros(len(columns[0]), np.int64))) for c in keys]
                yield pa.RecordBatch.from_arrays([*repeated, *columns], names)

    return rows.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), made]))


def _on_tiles(tiled: DataFrame, found: DataFrame, column: str, tile: int) -> DataFrame:
    """Boxes (image_id, box_id, sides, more) with each tile that they have pixels of."""
    cells = found
    for at, side in (("ty", "y"), ("tx", "x")):
        cells = cells.withColumn(at, F.explode(F.sequence(F.floor(F.col(f"{side}1") / tile), F.floor((F.col(f"{side}2") - 1) / tile)).cast("array<int>")))
    # a tile's bytes aren't seen by Spark's estimates of sizes, so these must not choose what is sent to all
    return tiled.select("image_id", "ty", "tx", "h", "w", column).hint("merge").join(cells, ["image_id", "ty", "tx"])


def _part(row: dict, tile: int) -> tuple[int, int, int, int]:
    """The rows and columns that a box has of its tile."""
    top, left = row["ty"] * tile, row["tx"] * tile
    return max(row["y1"], top), min(row["y2"], top + row["h"]), max(row["x1"], left), min(row["x2"], left + row["w"])


def blocks(tiled: DataFrame, found: DataFrame, tile: int, share: float = 0.15) -> DataFrame:
    """image_id, box_id of the boxes that are blocks, as regions.blocks has them: the set pixels of the fifth to eighth lines from each side are counted tile by tile."""

    def count(row):
        on, (y0, y1, x0, x1) = _bits(row), _part(row, tile)
        top, left = row["ty"] * tile, row["tx"] * tile
        rows, columns = on[:, x0 - left : x1 - left].sum(axis=1), on[y0 - top : y1 - top].sum(axis=0)
        lines = [(rows, row["y1"] + 5 - top), (rows, row["y2"] - 8 - top), (columns, row["x1"] + 5 - left), (columns, row["x2"] - 8 - left)]
        n = [int(counts[k]) if 0 <= k < len(counts) else 0 for counts, first in lines for k in range(first, first + 4)]
        return [pa.array([n], pa.list_(pa.int64()))]

    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    met = _on_tiles(tiled, found.filter((w >= 9) & (h >= 9)).select("image_id", "box_id", *SIDES), "bits", tile)
    counts = _map_tiles(met, count, ["image_id", "box_id", *SIDES], "n array<long>")
    counts = counts.groupBy("image_id", "box_id", *SIDES).agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(16)])
    full = [sum((F.col(f"n{k}") > share * (w if k < 8 else h)).cast("int") for k in range(side, side + 4)) for side in (0, 4, 8, 12)]
    return counts.filter(F.greatest(*full) <= 2).select("image_id", "box_id", F.lit(True).alias("is_block"))


def nested(tiled: DataFrame, compos: DataFrame, tolerance: int, tile: int) -> DataFrame:
    """image_id, box_id (of the component), seed, sides, replaces: even rectangular areas of components over 50 pixels high."""
    least, least_height = 500, 30

    def label(row):
        y0, y1, x0, x1 = _part(row, tile)
        top, left = row["ty"] * tile, row["tx"] * tile
        v = np.frombuffer(row["gray"], np.uint8).reshape(row["h"], row["w"])[y0 - top : y1 - top, x0 - left : x1 - left]
        return regions.pieces_of(kernels.pieces(v, np.ones(v.shape, bool), (y0, x0), (row["y1"], row["x1"]), tile, tolerance, (10, 10), least, True))

    big = cut(compos.filter(F.col("y2") - F.col("y1") > 50).withColumn("clip", F.monotonically_increasing_id()))
    frames = big.select(F.col("clip").alias("image_id"), (F.col("y2") - F.col("y1")).alias("within"), (F.col("x2") - F.col("x1")).alias("across"))
    parts = _map_tiles(_on_tiles(tiled, big.select("image_id", "clip", *SIDES), "gray", tile), label, ["clip"], regions.pieces_sql(True))
    found = regions.rectangular_areas(regions.united(parts.withColumnRenamed("clip", "image_id"), tolerance), frames, least, least_height)
    found = found.select(F.col("image_id").alias("clip"), "seed", "replaces", *[F.col(c).alias(f"n{c}") for c in SIDES])
    moved = [(F.col(f"n{c}") + F.col(f"{c[0]}1")).alias(c) for c in SIDES]
    return big.join(found, "clip").select("image_id", "box_id", "seed", "replaces", *moved)


def components(images: DataFrame, p: Params = Params(), tile: int = TILE) -> DataFrame:
    """image_id, box_id, category, x1, y1, x2, y2: the numbered components before the last merge, of images (image_id, height, width, channels, data)."""
    tiled = cut(tiles(images, p, tile))
    return _components(tiled, _sizes(tiled), p, tile)


def _sizes(tiled: DataFrame) -> DataFrame:
    return cut(tiled.filter("ty = 0 AND tx = 0").select("image_id", F.col("ih").cast("long").alias("ih"), F.col("iw").cast("long").alias("iw")))


def _components(tiled: DataFrame, sizes: DataFrame, p: Params, tile: int) -> DataFrame:

    def label(row):
        on = _bits(row)
        return regions.pieces_of(kernels.pieces(np.zeros(on.shape, np.int64), on, (row["ty"] * tile, row["tx"] * tile), (0, 0), tile, 0, (5, 2), p.min_ele_area, False))

    w, h = F.col("width"), F.col("height")
    least, most = F.least(w, h), F.greatest(w, h)
    plausible = (w * h >= p.min_ele_area) & (10 * h <= 8 * F.col("ih")) & (w <= 50 * h) & (h <= 40 * w) & ~((least < 8) & (most > 10 * least))
    parts = regions.united(_map_tiles(tiled.select("image_id", "ty", "tx", "h", "w", "bits"), label, ["image_id"], regions.pieces_sql(False)), 0)
    found = regions.measured(parts).filter((F.col("n_pixels") >= p.min_ele_area) & (w > 3) & (h > 3) & F.col("seed").isNotNull())
    found = found.join(sizes, "image_id").filter(plausible)
    merged = merging.merge_meeting(found.select("image_id", F.col("seed").alias("box_id"), *SIDES)).join(sizes, "image_id")
    merged = cut(merged.withColumn("alone", F.when(F.size("members") == 1, 1).otherwise(0)))  # a box of one region counts its pixels
    tall = (F.col("y2") - F.col("y1") + F.col("alone")) / F.col("ih") > 0.15
    wide = (F.col("x2") - F.col("x1") + F.col("alone")) / F.col("iw") > 0.15
    is_block = blocks(tiled, merged.filter(tall & wide), tile)
    compos = merged.join(is_block, ["image_id", "box_id"], "left").withColumn("category", F.when(F.col("is_block"), "Block").otherwise("Compo"))
    compos = cut(compos.select("image_id", "box_id", "category", *SIDES))
    if p.merge_contained_ele:
        compos = cut(boxes.drop_contained(compos))
    inner = cut(nested(tiled, compos, p.ffl_block, tile))
    instead = inner.filter("replaces").groupBy("image_id", "box_id").agg(F.min_by(F.struct(*SIDES), "seed").alias("r"))
    own = compos.join(instead, ["image_id", "box_id"], "left")
    own = own.select("image_id", "box_id", F.lit(-1).cast("long").alias("seed"), F.when(F.col("r").isNull(), F.col("category")).otherwise("Compo").alias("category"), *[F.coalesce(F.col(f"r.{c}"), F.col(c)).alias(c) for c in SIDES])
    more = inner.join(instead, ["image_id", "box_id"], "left_anti").select("image_id", "box_id", "seed", F.lit("Compo").alias("category"), *SIDES)
    order = Window.partitionBy("image_id").orderBy(F.col("seed") >= 0, "box_id", "seed")
    return own.unionByName(more).select("image_id", F.row_number().over(order).cast("long").alias("box_id"), "category", *SIDES)


def detect(images: DataFrame, p: Params = Params(), tile: int = TILE) -> DataFrame:
    """image_id, box_idx, x1, y1, x2, y2 in [0, 1), as plans.detect.detect has them."""
    tiled = cut(tiles(images, p, tile))
    sizes = _sizes(tiled)
    found = merging.merge_close(_components(tiled, sizes, p, tile).select("image_id", "box_id", *SIDES), p.max_dist)
    order = Window.partitionBy("image_id").orderBy("box_id")
    found = found.join(sizes, "image_id")
    side = lambda c: (F.col(c) / F.col("iw" if c[0] == "x" else "ih")).alias(c)
    return found.select("image_id", (F.row_number().over(order) - 1).cast("int").alias("box_idx"), *map(side, SIDES))

"""Images as rows and as pixel tables, from Spark's image source (PNG, JPEG and the like; channels in B, G, R order)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels

#: Pixels of an Arrow batch of pixel rows, about.
BATCH = 200_000


def read(spark: SparkSession, path: str, resize_height: int | None = None, kernel_size: int | None = None) -> DataFrame:
    """image_id, origin, height, width, channels, data; files that are no images are left out; median filtered and resized if wanted."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    found = raw.select(F.xxhash64("origin").alias("image_id"), "origin", "height", "width", F.col("nChannels").alias("channels"), "data")
    return found if resize_height is None and kernel_size is None else prepared(found, resize_height, kernel_size)


def prepared(images: DataFrame, resize_height: int | None = None, kernel_size: int | None = None) -> DataFrame:
    """Images after a median filter of kernel_size x kernel_size and a resize to a height, either if wanted."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                a = a if kernel_size is None else kernels.median(a, kernel_size)
                a = a if resize_height is None else kernels.resize(a, *resized(r["width"], r["height"], resize_height))
                r |= {"height": a.shape[0], "width": a.shape[1], "data": a.tobytes()}
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return images.mapInArrow(run, images.schema)


def array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """height x width x 3 in B, G, R order; one channel counts as gray, a fourth is dropped."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, b, g, r: a row per pixel, in batches of bounded size."""
    names = ["image_id", "y", "x", "b", "g", "r"]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = array(r["data"], r["height"], r["width"], r["channels"]).reshape(-1, 3).astype(np.int32)
                for at in range(0, len(a), BATCH):
                    part = a[at : at + BATCH]
                    y, x = np.divmod(np.arange(at, at + len(part)), r["width"])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), r["image_id"])), pa.array(y), pa.array(x), *(pa.array(part[:, k]) for k in range(3))], names)

    rows = images.select("image_id", "height", "width", "channels", "data")
    return rows.mapInArrow(run, "image_id long, y long, x long, b int, g int, r int")


def resized(width: int, height: int, to_height: int) -> tuple[int, int]:
    """(width, height) with the wanted height, whole pixels."""
    return int(to_height * (width / height)), int(to_height)


def resize(pixel_rows: DataFrame, width: int, height: int, to_height: int) -> DataFrame:
    """image_id, y, x, v of images of one size, resized to a height between the four pixels around each new one's centre, in fixed point as kernels.resize.

    The shares are tables of twice the new width and height, so they are small;
    one exchange by image serves the sums along rows and along columns.
    """
    w, h = resized(width, height, to_height)
    spark = pixel_rows.sparkSession

    def shares(old: int, new: int, names: str) -> DataFrame:
        lower, share = kernels.between(old, new)
        rows = [(int(i), k, int(s)) for k, (i, s) in enumerate(zip(lower, share))]
        rows += [(min(i + 1, old - 1), k, kernels.WHOLE - s) for i, k, s in rows]
        return F.broadcast(spark.createDataFrame([(i, k, s) for i, k, s in rows if s], names))

    x = pixel_rows.repartition("image_id").join(shares(width, w, "x long, nx long, a long"), "x")
    x = x.groupBy("image_id", "y", "nx").agg(F.sum(F.col("a") * F.col("v")).alias("s"))
    x = x.join(shares(height, h, "y long, ny long, b long"), "y")
    part = F.shiftright(F.col("b") * F.shiftright("s", 4), 16)
    x = x.groupBy("image_id", "ny", "nx").agg(F.sum(part).alias("s"))
    return x.select("image_id", F.col("ny").alias("y"), F.col("nx").alias("x"), F.shiftright(F.col("s") + 2, 2).alias("v"))

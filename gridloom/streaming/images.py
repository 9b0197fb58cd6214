"""Boxes of images that arrive in a folder: the plan of plans.detect on a stream, which needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import detect

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def stream(spark: SparkSession, path: str, params: detect.Params = detect.Params(), files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of detect's rows for the images of a folder."""
    raw = spark.readStream.format("image").schema(IMAGE).option("dropInvalid", True).option("maxFilesPerTrigger", files_per_trigger).load(path).select("image.*")
    images = raw.select(F.xxhash64("origin").alias("image_id"), "height", "width", F.col("nChannels").alias("channels"), "data")
    return detect.detect(images, params)

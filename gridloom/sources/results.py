"""Result documents: one JSON document per image with its shape and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drawing
from . import png

COMPONENT = "struct<id:bigint,class:string,column_min:bigint,row_min:bigint,column_max:bigint,row_max:bigint,width:bigint,height:bigint>"
DOCUMENT = f"struct<img_shape:array<bigint>,compos:array<{COMPONENT}>>"


def to_documents(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, document (JSON): of boxes (image_id, box_id, category, x1, y1, x2, y2)."""
    one = F.struct(
        F.col("box_id").alias("id"), F.col("category").alias("class"), F.col("x1").alias("column_min"), F.col("y1").alias("row_min"),
        F.col("x2").alias("column_max"), F.col("y2").alias("row_max"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"),
    )
    found = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("compos"))
    shape = F.array(F.lit(height), F.lit(width), F.lit(3)).cast("array<bigint>")
    return found.select("image_id", F.to_json(F.struct(shape.alias("img_shape"), "compos")).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """The components of JSON documents, one row each."""
    parsed = documents.select("image_id", F.from_json("document", DOCUMENT).alias("d"))
    return parsed.select("image_id", F.inline("d.compos")).withColumnRenamed("class", "category")


def write(documents: DataFrame, path: str) -> None:
    documents.select("document").write.mode("overwrite").text(path)


def write_csv(boxes: DataFrame, path: str) -> None:
    """Corners and sizes of components, as CSV."""
    boxes.select(F.col("category").alias("component"), F.col("x2").alias("x_max"), F.col("x1").alias("x_min"), F.col("y2").alias("y_max"), F.col("y1").alias("y_min"), (F.col("y2") - F.col("y1")).alias("height"), (F.col("x2") - F.col("x1")).alias("width")).write.mode("overwrite").option("header", True).csv(path)


def write_clippings(clips: DataFrame, path: str) -> None:
    """Clipped pixels by class, a folder for each: (category, image_id, box_id, y, x, v)."""
    clips.write.mode("overwrite").partitionBy("category").parquet(path)


def write_pictures(clips: DataFrame, path: str) -> None:
    """Clippings (category, nth, height, width, channels, data) as PNG files, a folder for each class, named by their number in it."""
    png.write(clips.select(F.format_string("%s/%d.png", "category", "nth").alias("path"), "height", "width", "channels", "data"), path)


def write_overlays(images: DataFrame, boxes: DataFrame, path: str, color: tuple[int, ...] = (0, 255, 0), line: int = 2) -> None:
    """Each image with the borders of its boxes, as a PNG file named by its id."""
    drawn = drawing.paint(images, drawing.box_spans(boxes, line), color)
    png.write(drawn.select(F.format_string("%d.png", "image_id").alias("path"), "height", "width", "channels", "data"), path)

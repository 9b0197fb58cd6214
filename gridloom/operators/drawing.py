"""Drawing on images and cutting pictures out of them: images are rows (image_id, height, width, channels, data).

Shapes become spans, runs of pixels of a row, as a scanline rasteriser makes
them: rows of a table, made in the JVM.  An image then takes its spans, in
order, in one pass; an image with its spans is what a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IMAGE = ("height", "width", "channels", "data")


def box_spans(boxes: DataFrame, line: int = 2) -> DataFrame:
    """image_id, y, lo, hi, nth (the box_id) of the borders of boxes, sides included: `line` pixels wide, of which the border itself is the middle one, or the first after it."""
    before, after = line // 2, (line - 1) // 2
    x = boxes.select("image_id", F.col("box_id").alias("nth"), *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])
    x = x.withColumn("y", F.explode(F.sequence(F.col("y1") - before, F.col("y2") + after)))
    level = ((F.col("y") <= F.col("y1") + after) | (F.col("y") >= F.col("y2") - before)) | (F.col("x2") - F.col("x1") <= before + after)
    run = lambda lo, hi: F.struct((F.col(lo) - before).alias("lo"), (F.col(hi) + after).alias("hi"))
    return x.select("image_id", "y", "nth", F.inline(F.when(level, F.array(run("x1", "x2"))).otherwise(F.array(run("x1", "x1"), run("x2", "x2")))))


def paint(images: DataFrame, spans: DataFrame, color: tuple[int, ...] = (0, 255, 0)) -> DataFrame:
    """Images with the spans (image_id, y, lo, hi, nth) in a colour, as many of whose numbers are taken as an image has channels; what lies outside isn't drawn."""
    own = spans.groupBy(F.col("image_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("nth", "y", "lo", "hi"))).alias("spans"))
    rows = images.join(own, F.col("image_id") == F.col("of"), "left").select(*images.columns, "spans")

    def run(batches):
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]).copy()
                for s in r["spans"] or ():
                    if 0 <= s["y"] < len(a):
                        a[s["y"], max(s["lo"], 0) : max(s["hi"] + 1, 0)] = color[: a.shape[2]]
                made.append(a.tobytes())
            yield batch.drop_columns("spans").set_column(batch.schema.get_field_index("data"), "data", pa.array(made, pa.binary()))

    return rows.mapInArrow(run, images.schema)


def clippings(images: DataFrame, boxes: DataFrame, pad: int = 2, extra: tuple[str, ...] = ()) -> DataFrame:
    """image_id, box_id, extra columns of boxes, and the picture of each box grown by pad inside its image; boxes without pixels give none."""
    names = ["box_id", *extra]
    one = F.struct(*names, *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])
    own = boxes.groupBy(F.col("image_id").alias("of")).agg(F.collect_list(one).alias("boxes"))
    rows = images.join(own, F.col("image_id") == F.col("of")).select("image_id", *_IMAGE, "boxes")
    kinds = dict(boxes.dtypes)

    def run(batches):
        for batch in batches:
            for k, r in enumerate(batch.select(["image_id", "height", "width", "channels", "boxes"]).to_pylist()):
                a = np.frombuffer(batch["data"][k].as_buffer(), np.uint8).reshape(r["height"], r["width"], r["channels"])
                found = [(b, a[max(b["y1"] - pad, 0) : max(b["y2"] + pad, 0), max(b["x1"] - pad, 0) : max(b["x2"] + pad, 0)]) for b in r["boxes"]]
                made = [{"image_id": r["image_id"], **{n: b[n] for n in names}, "height": c.shape[0], "width": c.shape[1], "channels": c.shape[2], "data": c.tobytes()} for b, c in found if c.size]
                if made:
                    yield pa.RecordBatch.from_pylist(made, pa.schema([(n, own_types[n]) for n in made[0]]))

    from pyspark.sql.pandas.types import to_arrow_type

    of_boxes = {f.name: to_arrow_type(f.dataType) for f in boxes.schema}
    own_types = {"image_id": to_arrow_type(images.schema["image_id"].dataType), **{n: of_boxes[n] for n in names}, "height": pa.int32(), "width": pa.int32(), "channels": pa.int32(), "data": pa.binary()}
    return rows.mapInArrow(run, ", ".join([f"image_id {dict(images.dtypes)['image_id']}", *(f"`{n}` {kinds[n]}" for n in names), "height int, width int, channels int, data binary"]))

"""Order-dependent merges of an image's boxes, in Arrow batches of whole images.

The merges are greedy: a box joins the first kept box that fits, and the union
may fit boxes that its parts did not, so they are no connected components and
can't be run in parallel inside an image.  Images are independent: an image is
one row, with its boxes in order, and a batch holds many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Boxes of the images whose results are made together, about.
TOGETHER = 20_000
NAMES = ("image_id", "box_id", "x1", "y1", "x2", "y2")
SCHEMA = ", ".join(f"{n} long" for n in NAMES) + ", members array<long>"


def _merge(boxes: DataFrame, how) -> DataFrame:
    """box_id: of the first member; members: ids of the boxes in it, sorted."""
    one = F.struct(*[F.col(c).cast("long").alias(c) for c in NAMES[1:]])
    images = boxes.groupBy(F.col("image_id").cast("long").alias("image_id")).agg(F.array_sort(F.collect_list(one)).alias("boxes"))

    def run(batches):
        for batch in batches:
            # a batch is worked on in parts, so that what Python holds doesn't grow with the images in it
            ends = np.append(0, np.cumsum(np.diff(batch["boxes"].offsets.to_numpy())))
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], TOGETHER)))
            for first, last in zip(cuts, [*cuts[1:], batch.num_rows]):
                yield merged(batch.slice(first, last - first))

    def merged(batch):
        lists = batch["boxes"]
        flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        rows = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in NAMES[1:]], axis=1)
        image, found, members = [], [], []
        for i, a, b in zip(batch["image_id"].to_pylist(), ends, ends[1:]):
            for box, own in how([(tuple(r[1:]), r[:1]) for r in rows[a:b].tolist()]):
                image.append(i), found.append((own[0], *box)), members.append(sorted(set(own)))
        columns = np.array(found, dtype=np.int64).reshape(-1, 5).T
        return pa.RecordBatch.from_arrays([pa.array(image, pa.int64()), *map(pa.array, columns), pa.array(members, pa.list_(pa.int64()))], [*NAMES, "members"])

    return images.mapInArrow(run, SCHEMA)


def merge_meeting(boxes: DataFrame) -> DataFrame:
    return _merge(boxes, kernels.merge_meeting)


def merge_close(boxes: DataFrame, distance: int = 20) -> DataFrame:
    return _merge(boxes, lambda x: kernels.merge_close(x, distance))


def merge_text(boxes: DataFrame, gap: int = 4, height: int = 20) -> DataFrame:
    return _merge(boxes, lambda x: kernels.merge_text(x, gap, height))


def merge_corners(boxes: DataFrame, with_contained: bool = False, gap: tuple[int, int] = (0, 0)) -> DataFrame:
    return _merge(boxes, lambda x: kernels.merge_corners(x, with_contained, gap))

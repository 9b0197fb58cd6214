"""From images and boxes to one vector per box: encoder, projection, triples, fuser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models, vectors


def embed(images: DataFrame, texts: DataFrame, encoder: models.EncoderConfig, fuser: models.FuserConfig, hidden: int, projector: models.Parameters | None = None) -> DataFrame:
    """image_id, box_idx, vec: of images (image_id, patches, boxes) and one text vector for each (image_id, vec); the projections' parameters are the encoder's, unless `projector` gives them."""
    tokens = models.encode_images(images, encoder)
    keyed = tokens.select(F.struct("image_id", "tok").alias("key"), "vec")
    projector = projector or encoder.parameters
    projected = models.project_vectors(keyed, "key", hidden, fuser.dim, projector).select("key.image_id", "key.tok", "vec")
    wholes = projected.filter("tok = 0").select("image_id", "vec")
    boxes = projected.filter("tok > 0").select("image_id", (F.col("tok") - 1).cast("long").alias("box_idx"), "vec")
    return models.fuse_triples(vectors.triples(boxes, wholes, models.project_texts(texts, "image_id", fuser.dim, projector)), fuser)


def patches(pixels: DataFrame, size: int, image_side: int, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """image_id, patches: array<array<double>>, row by row, of pixels (image_id, y, x, channels) cut into size x size squares; a patch holds channel after channel, each by rows."""
    side = image_side // size
    at = (F.floor(F.col("y") / size) * side + F.floor(F.col("x") / size)).alias("patch")
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", *channels)))
    one = F.concat(*[F.col(f"p.{c}").cast("array<double>") for c in channels])
    inside = pixels.filter((F.col("y") < side * size) & (F.col("x") < side * size))
    by_patch = inside.groupBy("image_id", at).agg(ordered.alias("p")).select("image_id", "patch", one.alias("vec"))
    return by_patch.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("patch", "vec"))).alias("p")).select("image_id", F.col("p.vec").alias("patches"))

"""Deterministic inputs from the test tables, by arithmetic that any SQL engine repeats; SQL has the same as CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..lineage import cut
from ..operators.ranks import numbered

#: Size of the images that boxes lie in; side of the rasters.
WIDTH, HEIGHT, SIDE = 800, 600, 32
#: Events that 20 images share.
EVENTS = 10_000
#: Pixels of rasters that a task makes, about.
PIXELS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, box_id, x1, y1, x2, y2: one box for each order line key; the lines are dealt by image once, which serves all that goes by image."""
    lines = table(spark, sf_dir, "lineitem").withColumn("image_id", F.floor(F.col("l_orderkey") / 20)).select("image_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = lines.repartition("image_id").groupBy("image_id", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    n = F.col("l_linenumber").cast("long")
    x1, y1 = F.col("p") * 37 % 700, (F.col("s") * 53 + n * 97) % 500
    w, h = 4 + F.col("p") * 11 % 90, 4 + (F.col("s") * 7 + n * 5) % 60
    return keys.select("image_id", (F.col("l_orderkey") * 10 + n).alias("box_id"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"))


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes with a category: every seventh is a Block, every fifth of the others an Image, every eleventh of those left Noise."""
    b = F.col("box_id")
    return boxes(spark, sf_dir).withColumn("category", F.when(b % 7 == 0, "Block").when(b % 5 == 0, "Image").when(b % 11 == 0, "Noise").otherwise("Compo"))


def _image():
    """Events are dealt to 20 images by user, and to 20 more after every EVENTS of them, so images grow in number with the table."""
    return F.floor(F.col("event_id") / EVENTS) * 20 + F.col("user_id") % 20


def _dealt(ids: DataFrame, each: int) -> DataFrame:
    """Image ids over so many tasks that each makes PIXELS pixels at most, about; their bytes don't say how many pixels they become."""
    ids = cut(ids)
    least = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ids.repartition(max(least, -(-ids.count() * each // PIXELS)), "image_id")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: a whole SIDE x SIDE gray raster for each of 20 images per EVENTS events, 0 where no event falls."""
    e = table(spark, sf_dir, "events")
    at = [_image().alias("image_id"), (F.floor(F.col("event_id") / SIDE) % SIDE).alias("y"), (F.col("event_id") % SIDE).alias("x")]
    v = e.groupBy(*at).agg(F.max(F.floor("value") % 256).alias("v"))
    side = F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))
    grid = _dealt(e.select(_image().alias("image_id")).distinct(), SIDE * SIDE).withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    return grid.join(v, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v = 255: the pixels that an event with a value over 20 falls on."""
    e = table(spark, sf_dir, "events").filter("value > 20")
    at = [_image().alias("image_id"), (F.floor(F.col("event_id") / SIDE) % SIDE).alias("y"), (F.col("event_id") % SIDE).alias("x")]
    return e.select(*at).distinct().withColumn("v", F.lit(255).cast("long"))


def stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster as 0 and 255 with some rows of each image filled, so that there are lines; some have gaps."""
    full = (F.col("y") + F.col("image_id")) % 11 < (F.col("image_id") % 4 + 1)
    hole = (F.col("image_id") % 3 == 0) & F.col("x").between(10, 11 + F.col("image_id") % 8)
    return raster(spark, sf_dir).withColumn("v", F.when(full & ~hole, 255).when(F.col("v") > 40, 255).otherwise(0))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, box_id, x1, y1, x2, y2: four boxes in each raster."""
    ids = table(spark, sf_dir, "events").select(_image().alias("image_id")).distinct().withColumn("box_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    k = F.col("image_id") * 4 + F.col("box_id")
    x = ids.withColumn("x1", k * 5 % 12).withColumn("y1", k * 7 % 12)
    return x.withColumn("x2", F.col("x1") + 12 + k * 3 % 8).withColumn("y2", F.col("y1") + 12 + k * 11 % 8)


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: a dark rectangle on a checkered ground, 64 x 64, for each raster."""
    k, side = F.col("image_id"), F.sequence(F.lit(0).cast("long"), F.lit(2 * SIDE - 1).cast("long"))
    ids = table(spark, sf_dir, "events").select(_image().alias("image_id")).distinct()
    x = _dealt(ids, 4 * SIDE * SIDE).withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    inside = F.col("y").between(4 + k % 5, 50 + k % 7) & F.col("x").between(5 + k % 3, 52 + k % 6)
    return x.withColumn("v", F.when(inside, 0).otherwise(100 + 100 * ((F.col("x") + F.col("y")) % 2)))


def images(spark: SparkSession, sf_dir: str, scale: int = 8) -> DataFrame:
    """image_id, height, width, channels, data: the stripes as gray images, each pixel as a scale x scale square."""
    import numpy as np
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        a = np.zeros((SIDE, SIDE), np.uint8)
        a[table["y"].to_numpy(), table["x"].to_numpy()] = table["v"].to_numpy()
        a = np.kron(a, np.ones((scale, scale), np.uint8))
        side = pa.array([SIDE * scale], pa.int32())
        return pa.table({"image_id": table["image_id"].slice(0, 1), "height": side, "width": side, "channels": pa.array([1], pa.int32()), "data": [a.tobytes()]})

    return stripes(spark, sf_dir).groupBy("image_id").applyInArrow(run, "image_id long, height int, width int, channels int, data binary")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, pos (in the label, by vec_id), seq (the whole label), vec ARRAY<DOUBLE>."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), doubles(F.col("embedding")).alias("vec"))
    e = numbered(e, ["label"], ["vec_id"], "pos").withColumn("pos", F.col("pos") - 1)
    return e.withColumn("seq", F.col("label") * 1000000)


SQL = f"""
boxes AS (
  SELECT l_orderkey // 20 AS image_id, l_orderkey * 10 + l_linenumber AS box_id, p * 37 % 700 AS x1, (s * 53 + l_linenumber * 97) % 500 AS y1,
         p * 37 % 700 + 4 + p * 11 % 90 AS x2, (s * 53 + l_linenumber * 97) % 500 + 4 + (s * 7 + l_linenumber * 5) % 60 AS y2
  FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, MIN(l_partkey) AS p, MIN(l_suppkey) AS s FROM lineitem GROUP BY ALL)),
categorised AS (
  SELECT *, CASE WHEN box_id % 7 = 0 THEN 'Block' WHEN box_id % 5 = 0 THEN 'Image' WHEN box_id % 11 = 0 THEN 'Noise' ELSE 'Compo' END AS category FROM boxes),
hits AS (SELECT event_id // {EVENTS} * 20 + user_id % 20 AS image_id, event_id // {SIDE} % {SIDE} AS y, event_id % {SIDE} AS x, CAST(floor(value) AS BIGINT) AS w, value FROM events),
raster AS (
  SELECT i.image_id, g.y, g.x, COALESCE(h.v, 0) AS v
  FROM (SELECT DISTINCT image_id FROM hits) i
  CROSS JOIN (SELECT a.range AS y, b.range AS x FROM range({SIDE}) a CROSS JOIN range({SIDE}) b) g
  LEFT JOIN (SELECT image_id, y, x, MAX(w % 256) AS v FROM hits GROUP BY ALL) h ON h.image_id = i.image_id AND h.y = g.y AND h.x = g.x),
bits AS (SELECT DISTINCT image_id, y, x, 255 AS v FROM hits WHERE value > 20),
stripes AS (
  SELECT image_id, y, x, CASE WHEN (y + image_id) % 11 < image_id % 4 + 1 AND NOT (image_id % 3 = 0 AND x BETWEEN 10 AND 11 + image_id % 8) THEN 255
    WHEN v > 40 THEN 255 ELSE 0 END AS v FROM raster),
frames AS (
  SELECT image_id, b.range AS box_id, k * 5 % 12 AS x1, k * 7 % 12 AS y1, k * 5 % 12 + 12 + k * 3 % 8 AS x2, k * 7 % 12 + 12 + k * 11 % 8 AS y2
  FROM (SELECT DISTINCT image_id FROM hits) i CROSS JOIN range(4) b, LATERAL (SELECT i.image_id * 4 + b.range AS k) l),
vectors AS (
  SELECT *, label * 1000000 AS seq FROM (
    SELECT vec_id, CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
           CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)),
parts AS (SELECT vec_id, label, pos, seq, generate_subscripts(vec, 1) - 1 AS i, unnest(vec) AS x FROM vectors)
"""

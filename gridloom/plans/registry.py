"""The library's own queries over the fixture tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import boxes, drawing, kernels, merging, models, pixels, regions, tiled
from ..operators import vectors as sequences
from ..operators.ranks import numbered
from ..sources import images, results
from . import embed, spread
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", recursive: bool = False):
    """Register a function under its name; sql: a SELECT over the fixtures' CTEs and `more` of them."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{fx.SQL}{',' + more if more else ''}\n{sql}"
        return f

    return add


# boxes


def _relation_sql(bias: tuple[int, int]) -> str:
    return f"""
pairs AS (
  SELECT a.image_id, a.box_id AS a_box_id, b.box_id AS b_box_id, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab,
         greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + {2 * bias[0]}) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + {2 * bias[1]}) AS c,
         a.category AS ca, b.category AS cb, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM categorised a JOIN categorised b ON a.image_id = b.image_id AND a.box_id < b.box_id),
related AS (
  SELECT *, CASE WHEN c = 0 THEN 0 WHEN c >= aa THEN -1 WHEN c >= ab THEN 1
    WHEN c / (aa + ab - c) >= 0.02 OR c / aa > 0.2 OR c / ab > 0.2 THEN 2 ELSE 0 END AS relation FROM pairs)"""


_RELATED = _relation_sql((0, 0))
_COUNTS = "SELECT image_id, relation, COUNT(*) AS n_pairs FROM related GROUP BY ALL"


@query(_COUNTS, _RELATED)
def box_relation(spark, sf_dir):
    return boxes.relation_counts(fx.boxes(spark, sf_dir))


@query(_COUNTS, _relation_sql((4, 2)))
def box_relation_bias(spark, sf_dir):
    return boxes.relation_counts(fx.boxes(spark, sf_dir), (4, 2))


@query(
    """SELECT image_id, CASE WHEN ax1 > bx1 AND ay1 > by1 AND ax2 < bx2 AND ay2 < by2 THEN -1 WHEN ax1 < bx1 AND ay1 < by1 AND ax2 > bx2 AND ay2 > by2 THEN 1
    WHEN ax1 > bx2 OR ay1 > by2 OR bx1 > ax2 OR by1 > ay2 THEN 0 ELSE 2 END AS relation, COUNT(*) AS n_pairs FROM pairs GROUP BY ALL""",
    _RELATED,
)
def box_relation_strict(spark, sf_dir):
    return boxes.strict_relation_counts(fx.boxes(spark, sf_dir))


_MIXED = "mixed AS (SELECT image_id, box_id, x1, y1, x1 + (x2 - x1) * k AS x2, y1 + (y2 - y1) * k AS y2 FROM (SELECT *, CASE WHEN box_id % 97 = 0 THEN 500 WHEN box_id % 13 = 0 THEN 9 ELSE 1 END AS k FROM boxes))"


@query("SELECT a.image_id, a.box_id AS a_box_id, b.box_id AS b_box_id FROM mixed a JOIN mixed b ON a.image_id = b.image_id AND a.box_id < b.box_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2", _MIXED)
def box_pairs_mixed(spark, sf_dir):
    """Pairs with a common point of boxes from 4 to 47,000 pixels."""
    k = F.when(F.col("box_id") % 97 == 0, 500).when(F.col("box_id") % 13 == 0, 9).otherwise(1)
    grown = fx.boxes(spark, sf_dir).withColumn("x2", F.col("x1") + (F.col("x2") - F.col("x1")) * k).withColumn("y2", F.col("y1") + (F.col("y2") - F.col("y1")) * k)
    return boxes.near_pairs(grown).select("image_id", "a_box_id", "b_box_id")


@query("SELECT image_id, MIN(x1) AS x1, MIN(y1) AS y1, MAX(x2) AS x2, MAX(y2) AS y2 FROM boxes GROUP BY image_id")
def box_union_by_image(spark, sf_dir):
    return boxes.union_by_image(fx.boxes(spark, sf_dir))


@query("SELECT image_id, a_box_id, b_box_id, least(ax1, bx1) AS x1, least(ay1, by1) AS y1, greatest(ax2, bx2) AS x2, greatest(ay2, by2) AS y2 FROM related WHERE relation = 2", _RELATED)
def box_merge_pairs(spark, sf_dir):
    return boxes.merged_pairs(fx.boxes(spark, sf_dir))


@query(
    "SELECT image_id, box_id, x1 + x0 AS x1, y1 + y0 AS y1, x2 + x0 AS x2, y2 + y0 AS y2 FROM boxes JOIN (SELECT image_id, MIN(x1) AS x0, MIN(y1) AS y0 FROM boxes GROUP BY image_id) o USING (image_id)",
)
def box_translate(spark, sf_dir):
    b = fx.boxes(spark, sf_dir)
    return boxes.translate(b, b.groupBy("image_id").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0")))


@query("SELECT image_id, box_id, greatest(x1 - 5, 0) AS x1, greatest(y1 - 5, 0) AS y1, least(x2 + 5, 760) AS x2, least(y2 + 5, 540) AS y2 FROM boxes")
def box_pad(spark, sf_dir):
    return boxes.pad(fx.boxes(spark, sf_dir), 5, 760, 540)


@query("SELECT image_id, box_id, round(x1 / 800.0::DOUBLE, 6) AS nx1, round(y1 / 600.0::DOUBLE, 6) AS ny1, round(x2 / 800.0::DOUBLE, 6) AS nx2, round(y2 / 600.0::DOUBLE, 6) AS ny2 FROM boxes")
def box_normalize(spark, sf_dir):
    n = boxes.normalize(fx.boxes(spark, sf_dir), fx.WIDTH, fx.HEIGHT)
    return n.select("image_id", "box_id", *[F.round(c, 6).alias(c) for c in ("nx1", "ny1", "nx2", "ny2")])


@query(
    """SELECT image_id, box_id, COUNT(*) AS n, MIN(i) AS first, MAX(i) AS last FROM (
    SELECT image_id, CASE WHEN relation = -1 THEN b_box_id ELSE a_box_id END AS box_id, CASE WHEN relation = -1 THEN a_box_id ELSE b_box_id END AS i
    FROM related WHERE relation IN (-1, 1)) GROUP BY ALL""",
    _RELATED,
)
def box_containment(spark, sf_dir):
    c = boxes.containment(fx.boxes(spark, sf_dir))
    return c.select("image_id", "box_id", F.size("contain").cast("long").alias("n"), F.array_min("contain").alias("first"), F.array_max("contain").alias("last"))


@query(
    """SELECT image_id, box_id, category FROM categorised WHERE (image_id, box_id) NOT IN (
    SELECT (image_id, a_box_id) FROM related WHERE relation = -1 AND cb <> 'Block' UNION ALL SELECT (image_id, b_box_id) FROM related WHERE relation = 1 AND ca <> 'Block')""",
    _RELATED,
)
def box_drop_contained(spark, sf_dir):
    return boxes.drop_contained(fx.categorised(spark, sf_dir)).select("image_id", "box_id", "category")


@query("SELECT image_id, a_box_id, b_box_id FROM pairs WHERE least(ay2, by2) > greatest(ay1, by1) AND least(abs(ax1 - bx2), abs(bx1 - ax2)) < 20", _RELATED)
def box_close_pairs(spark, sf_dir):
    return boxes.close_pairs(fx.boxes(spark, sf_dir), 20)


@query(
    """SELECT image_id, box_id, w AS width, h AS height FROM (SELECT image_id, box_id, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h FROM boxes)
    WHERE w * h >= 500 AND h <= 0.8 * 70 AND w / h <= 50 AND h / w <= 40 AND NOT (least(w, h) < 8 AND greatest(w / h, h / w) > 10)""",
)
def box_filter(spark, sf_dir):
    b = fx.boxes(spark, sf_dir).withColumn("width", F.col("x2") - F.col("x1") + 1).withColumn("height", F.col("y2") - F.col("y1") + 1)
    return boxes.keep_plausible(b, 500, 70).select("image_id", "box_id", "width", "height")


@query("SELECT image_id, box_id FROM boxes WHERE NOT (y2 < 600 * 0.045 OR y1 > 500 * 0.94)")
def box_top_bottom(spark, sf_dir):
    return boxes.drop_bars(fx.boxes(spark, sf_dir), 600, 0.045, 500 * 0.94 / 600).select("image_id", "box_id")


@query("SELECT image_id, box_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, box_id) AS INTEGER) AS nth FROM boxes")
def box_ids(spark, sf_dir):
    return boxes.number(fx.boxes(spark, sf_dir), ["y1", "x1", "box_id"]).select("image_id", "box_id", "nth")


@query("SELECT image_id, box_id, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area FROM boxes")
def box_sizes(spark, sf_dir):
    return boxes.sizes(fx.boxes(spark, sf_dir)).select("image_id", "box_id", "width", "height", "area")


@query("SELECT image_id, box_id, category, CAST(row_number() OVER (PARTITION BY image_id, category ORDER BY box_id) AS INTEGER) AS nth FROM categorised")
def box_clipping_index(spark, sf_dir):
    return boxes.numbered_clippings(fx.categorised(spark, sf_dir)).select("image_id", "box_id", "category", "nth")


@query("SELECT category, image_id, box_id, row_number() OVER (PARTITION BY category ORDER BY image_id, box_id) AS nth FROM categorised")
def box_category_rank(spark, sf_dir):
    """Running numbers in few large groups, found range by range."""
    b = fx.categorised(spark, sf_dir).select("category", "image_id", "box_id")
    return numbered(b, ["category"], ["image_id", "box_id"], "nth", spread_from=1000)


@query("SELECT image_id, box_id, category FROM categorised WHERE category <> 'Noise'")
def box_drop_noise(spark, sf_dir):
    return boxes.drop_noise(fx.categorised(spark, sf_dir)).select("image_id", "box_id", "category")


@query(
    """SELECT image_id, box_id, category FROM categorised WHERE (image_id, box_id) NOT IN (
    SELECT (image_id, CASE WHEN relation = -1 THEN a_box_id ELSE b_box_id END) FROM related
    WHERE relation = -1 AND cb = 'Image' OR relation = 1 AND ca = 'Image')""",
    _RELATED,
)
def box_drop_inside_images(spark, sf_dir):
    b = fx.categorised(spark, sf_dir)
    held = b.join(boxes.containment(b), ["image_id", "box_id"], "left")
    return boxes.drop_inside_images(held).select("image_id", "box_id", "category")


def _merged(merged: DataFrame) -> DataFrame:
    return merged.select("image_id", "box_id", "x1", "y1", "x2", "y2", F.size("members").alias("n_members"))


#: Order-dependent merges as walks over lists of boxes, a step for each box; k: the first kept box that fits `it`, 0 for none.
_START = "start AS (SELECT image_id, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'id': box_id, 'ms': [box_id]} ORDER BY box_id) AS items FROM boxes GROUP BY image_id)"
_HULL = "{{'x1': least({0}.x1, {1}.x1), 'y1': least({0}.y1, {1}.y1), 'x2': greatest({0}.x2, {1}.x2), 'y2': greatest({0}.y2, {1}.y2), 'id': {0}.id, 'ms': list_distinct({0}.ms || {1}.ms)}}"
_COMMON = "(greatest(0, least(p.x2, {0}.x2) - greatest(p.x1, {0}.x1) + {1}) * greatest(0, least(p.y2, {0}.y2) - greatest(p.y1, {0}.y1) + {1}))"
_AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
_PILES = """SELECT image_id, m.id AS box_id, m.x1 AS x1, m.y1 AS y1, m.x2 AS x2, m.y2 AS y2, CAST(len(m.ms) AS INTEGER) AS n_members
  FROM (SELECT image_id, unnest(items) AS m FROM walk WHERE done)"""


def _much(item: str, gap: int = 0) -> str:
    c, a, b = _COMMON.format(item, gap), _AREA.format(item), _AREA.format("p")
    return f"(50 * {c} >= {a} + {b} - {c} OR 5 * {c} > {a} OR 5 * {c} > {b})"


def _first_fit_sql(fits: str, may: str = "true") -> str:
    return f"""
{_START},
walk(image_id, items, kept, i, done) AS (
  SELECT image_id, items, items[1:0], 1, false FROM start
  UNION ALL
  SELECT image_id, CASE WHEN i > len(items) THEN kept ELSE items END,
    CASE WHEN i > len(items) THEN items[1:0] WHEN k > 0 THEN kept[1:k - 1] || [{_HULL.format("kept[k]", "it")}] || kept[k + 1:] ELSE kept || [it] END,
    CASE WHEN i > len(items) THEN 1 ELSE i + 1 END, i > len(items) AND len(kept) = len(items)
  FROM (SELECT *, items[i] AS it, CASE WHEN i > len(items) OR NOT ({may}) THEN 0
          ELSE COALESCE(list_position(list_transform(kept, lambda p: {fits}), true), 0) END AS k FROM walk WHERE NOT done))"""


_IT = "items[i]"
_MEETS = f"({_COMMON.format(_IT, 0)} > 0 AND {_COMMON.format(_IT, 0)} < {_AREA.format(_IT)} AND {_COMMON.format(_IT, 0)} < {_AREA.format('p')} AND {_much(_IT)})"
_ON_LINE = f"(least(p.y2, {_IT}.y2) > greatest(p.y1, {_IT}.y1) AND greatest(p.x1, {_IT}.x1) - least(p.x2, {_IT}.x2) < 4 AND greatest(p.x1, {_IT}.x1) <> least(p.x2, {_IT}.x2))"
_ROUNDS = f"""
{_START},
walk(image_id, items, rest, size, done) AS (
  SELECT image_id, items[1:0], items, len(items), false FROM start
  UNION ALL
  SELECT image_id, CASE WHEN len(rest) = 0 AND len(items) < size THEN items[1:0] WHEN len(rest) = 0 THEN items
      WHEN k > 0 THEN items || [{_HULL.format("rest[1]", "rest[k + 1]")}] ELSE items || [rest[1]] END,
    CASE WHEN len(rest) = 0 AND len(items) < size THEN items WHEN len(rest) = 0 THEN rest WHEN k > 0 THEN rest[2:k] || rest[k + 2:] ELSE rest[2:] END,
    CASE WHEN len(rest) = 0 THEN len(items) ELSE size END, len(rest) = 0 AND len(items) = size
  FROM (SELECT *, COALESCE(list_position(list_transform(rest[2:], lambda p: least(p.y2, rest[1].y2) > greatest(p.y1, rest[1].y1)
          AND least(abs(rest[1].x1 - p.x2), abs(p.x1 - rest[1].x2)) < 20), true), 0) AS k FROM walk WHERE NOT done))"""
_CORNERS = f"""
{_START},
walk(image_id, items, kept, i, it, last, home, done) AS (
  SELECT image_id, items, items[1:0], 1, items[1], 0::BIGINT, false, false FROM start
  UNION ALL
  SELECT image_id, CASE WHEN over THEN kept ELSE items END,
    CASE WHEN over THEN items[1:0] WHEN k > 0 THEN kept[1:k - 1] || [{_HULL.format("kept[k]", "it")}] || kept[k + 1:] WHEN home THEN kept ELSE kept || [it] END,
    CASE WHEN over THEN 1 WHEN k > 0 THEN i ELSE i + 1 END,
    CASE WHEN over THEN kept[1] WHEN k > 0 THEN {_HULL.format("kept[k]", "it")} ELSE items[i + 1] END,
    CASE WHEN NOT over AND k > 0 THEN k ELSE 0 END, NOT over AND k > 0, over AND len(kept) = len(items)
  FROM (SELECT *, i > len(items) AS over, CASE WHEN i > len(items) THEN 0 ELSE COALESCE(list_position(list_transform(kept, lambda p, n: n > last AND {_COMMON.format("it", 4)} > 0
          AND ({_COMMON.format("it", 4)} >= {_AREA.format("it")} OR {_COMMON.format("it", 4)} >= {_AREA.format("p")} OR {_much("it", 4)})), true), 0) END AS k FROM walk WHERE NOT done))"""


@query(_PILES, _first_fit_sql(_MEETS), recursive=True)
def box_merge_greedy(spark, sf_dir):
    return _merged(merging.merge_meeting(fx.boxes(spark, sf_dir)))


@query(_PILES, _ROUNDS, recursive=True)
def box_merge_close(spark, sf_dir):
    return _merged(merging.merge_close(fx.boxes(spark, sf_dir)))


@query(_PILES, _CORNERS, recursive=True)
def box_merge_corners(spark, sf_dir):
    return _merged(merging.merge_corners(fx.boxes(spark, sf_dir), True, (2, 2)))


@query(_PILES, _first_fit_sql(_ON_LINE, f"{_IT}.y2 - {_IT}.y1 <= 20"), recursive=True)
def text_merge(spark, sf_dir):
    return _merged(merging.merge_text(fx.boxes(spark, sf_dir)))


# pixels


@query("SELECT image_id, y, x, (299 * v + 587 * (v * 3 % 256) + 114 * (v * 7 % 256) + 500) // 1000 AS v FROM raster")
def px_gray(spark, sf_dir):
    p = fx.raster(spark, sf_dir)
    return pixels.gray(p.select("image_id", "y", "x", F.col("v").alias("r"), (F.col("v") * 3 % 256).alias("g"), (F.col("v") * 7 % 256).alias("b")))


_STEPS = """
steps AS (
  SELECT image_id, y, x, v, abs(COALESCE(lead(v) OVER r, lag(v) OVER r, v) - v) + abs(COALESCE(lead(v) OVER c, lag(v) OVER c, v) - v) AS g
  FROM raster WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"""


@query("SELECT image_id, y, x, g % 256 AS v FROM steps", _STEPS)
def px_gradient(spark, sf_dir):
    return pixels.gradient(fx.raster(spark, sf_dir))


@query("SELECT image_id, y, x, least(g, 255) AS v FROM steps", _STEPS)
def px_gradient_saturated(spark, sf_dir):
    return pixels.gradient(fx.raster(spark, sf_dir), saturate=True)


@query("SELECT image_id, y, x, CASE WHEN g % 256 > 10 THEN 255 ELSE 0 END AS v FROM steps", _STEPS)
def px_threshold(spark, sf_dir):
    return pixels.threshold(pixels.gradient(fx.raster(spark, sf_dir)), 10)


@query("SELECT image_id, y, x, CASE WHEN v <= 1 THEN 255 ELSE 0 END AS v FROM raster")
def px_invert(spark, sf_dir):
    return pixels.invert(fx.raster(spark, sf_dir))


@query(
    """SELECT image_id, y, x, MIN(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM (
    SELECT image_id, y, x, MAX(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM stripes)""",
)
def px_close(spark, sf_dir):
    return pixels.close_gaps(fx.stripes(spark, sf_dir))


@query(
    """SELECT image_id, y, x, MIN(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM (
    SELECT image_id, y, x, MIN(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS v FROM (
    SELECT image_id, y, x, MAX(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM (
    SELECT image_id, y, x, MAX(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS v FROM raster)))""",
)
def px_close_wide(spark, sf_dir):
    return pixels.close_gaps(fx.raster(spark, sf_dir), (10, 7))


_VALID = """
holes AS (
  SELECT image_id, y, x, v, CASE WHEN v > 0 THEN x - max(CASE WHEN v > 0 THEN x END) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 END AS hole FROM stripes),
valid AS (SELECT image_id, y, COUNT(CASE WHEN v > 0 THEN 1 END) > 0.95 * COUNT(*) AND COALESCE(MAX(hole), 0) <= 5 AS valid FROM holes GROUP BY ALL)"""


@query("SELECT image_id, y, valid FROM valid", _VALID)
def px_valid_rows(spark, sf_dir):
    return pixels.valid_rows(fx.stripes(spark, sf_dir))


@query(
    "SELECT s.image_id, s.y, s.x, CASE WHEN b.y0 IS NULL THEN s.v ELSE 0 END AS v FROM stripes s LEFT JOIN bands b ON s.image_id = b.image_id AND s.y BETWEEN b.y0 AND b.y1",
    _VALID
    + """,
bands AS (
  SELECT image_id, MIN(y) AS y0, MAX(y) AS y1 FROM (SELECT image_id, y, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS run FROM valid WHERE valid)
  GROUP BY image_id, run HAVING COUNT(*) < 8)""",
)
def px_rm_line_simple(spark, sf_dir):
    return pixels.erase_lines_simple(fx.stripes(spark, sf_dir))


#: Runs of line rows [a, b) one after the other: a thin one goes if nothing begins in the 10 rows behind it (its room).
_BANDS = """
runs AS (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY a) AS k, a, b, lead(a) OVER w AS c, lead(b) OVER w AS d, n FROM (
    SELECT image_id, MIN(y) AS a, MAX(y) + 1 AS b FROM (SELECT image_id, y, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS run FROM valid WHERE valid) GROUP BY image_id, run)
  JOIN (SELECT image_id, MAX(y) + 1 AS n FROM valid GROUP BY image_id) USING (image_id) WINDOW w AS (PARTITION BY image_id ORDER BY a)),
walk(image_id, k, from_row, y0, y1) AS (
  SELECT DISTINCT image_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM runs
  UNION ALL
  SELECT w.image_id, r.k,
    CASE WHEN r.b - greatest(r.a, w.from_row) BETWEEN 1 AND 7 AND r.b < r.n AND r.c <= r.b + 9 AND (r.d > r.b + 9 OR r.d = r.n) THEN least(r.b + 10, r.n) ELSE w.from_row END,
    greatest(r.a, w.from_row),
    CASE WHEN r.b - greatest(r.a, w.from_row) NOT BETWEEN 1 AND 7 THEN NULL WHEN r.b = r.n THEN r.n - 2 WHEN r.c IS NULL OR r.c > r.b + 9 THEN r.b - 1 END
  FROM walk w JOIN runs r ON r.image_id = w.image_id AND r.k = w.k + 1)"""


@query(
    "SELECT s.image_id, s.y, s.x, CASE WHEN b.y0 IS NULL THEN s.v ELSE 0 END AS v FROM stripes s LEFT JOIN walk b ON s.image_id = b.image_id AND s.y BETWEEN b.y0 AND b.y1",
    _VALID + "," + _BANDS,
    recursive=True,
)
def px_rm_line_exact(spark, sf_dir):
    return pixels.erase_lines(fx.stripes(spark, sf_dir))


_RUNS = """
{0}_runs AS (
  SELECT image_id, {2} AS line, MIN({1}) AS lo, MAX({1}) AS hi FROM (
    SELECT image_id, y, x, {1} - row_number() OVER (PARTITION BY image_id, {2} ORDER BY {1}) AS run FROM stripes WHERE v > 0)
  GROUP BY image_id, {2}, run HAVING COUNT(*) > 0.6 * 32),
{0}_lines AS (SELECT image_id, line, arg_min(lo, lo) AS lo, arg_min(hi, lo) AS hi FROM {0}_runs GROUP BY ALL),
{0}_bands AS (
  SELECT image_id, line, lo, hi, COUNT(*) OVER b AS n, MAX(line) OVER b AS last FROM (
    SELECT *, line - row_number() OVER (PARTITION BY image_id ORDER BY line) AS band FROM {0}_lines) WINDOW b AS (PARTITION BY image_id, band))"""


@query(
    """SELECT s.image_id, s.y, s.x, CASE WHEN r.line IS NULL AND c.line IS NULL THEN s.v ELSE 0 END AS v FROM stripes s
    LEFT JOIN row_bands r ON r.image_id = s.image_id AND r.line = s.y AND s.x BETWEEN r.lo AND r.hi AND r.n < 8 AND r.last < 31
    LEFT JOIN column_bands c ON c.image_id = s.image_id AND c.line = s.x AND c.n < 8 AND c.last < 31""",
    _RUNS.format("row", "x", "y") + "," + _RUNS.format("column", "y", "x"),
)
def px_rm_line_v_h(spark, sf_dir):
    return pixels.erase_lines_both(fx.stripes(spark, sf_dir))


@query("SELECT r.image_id, f.box_id, r.y, r.x, r.v FROM raster r JOIN frames f ON r.image_id = f.image_id AND r.x >= f.x1 - 1 AND r.x < f.x2 + 1 AND r.y >= f.y1 - 1 AND r.y < f.y2 + 1")
def px_clip(spark, sf_dir):
    return pixels.clip(fx.raster(spark, sf_dir), fx.frames(spark, sf_dir), 1)


# regions

#: From each pixel to all that it reaches through lesser pixels' steps; the least of them names the region.
_REGIONS = """
edges AS (
  SELECT a.image_id, a.y * 1048576 + a.x AS p, b.y * 1048576 + b.x AS q FROM {0} a JOIN {0} b ON a.image_id = b.image_id
    AND (abs(a.x - b.x) + abs(a.y - b.y)) = 1 AND abs(a.v - b.v) <= {1}),
reach(image_id, p, root) AS (
  SELECT image_id, y * 1048576 + x, y * 1048576 + x FROM {0}
  UNION SELECT r.image_id, e.q, r.root FROM reach r JOIN edges e ON r.image_id = e.image_id AND r.p = e.p AND r.root < e.q),
labels AS (SELECT image_id, p // 1048576 AS y, p % 1048576 AS x, MIN(root) AS comp FROM reach GROUP BY ALL)"""
_BITS = _REGIONS.format("bits", 0)


def _labels(spark, sf_dir):
    return regions.label(fx.bits(spark, sf_dir))


_SMALL = """
hit AS (SELECT DISTINCT s.image_id, s.y, s.x FROM stripes s JOIN frames b ON s.image_id = b.image_id AND s.y BETWEEN b.y1 - 1 AND b.y2 AND s.x BETWEEN b.x1 - 1 AND b.x2
  WHERE s.y <= b.y1 OR s.y >= b.y2 - 1 OR s.x <= b.x1 OR s.x >= b.x2 - 1)"""


def _pixels_of(images_):
    """image_id, y, x, v of gray images."""
    values = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, 1)), 16, 10).cast("long"))).alias("at", "v")
    x = images_.select("image_id", F.col("width").cast("long").alias("w"), values)
    return x.select("image_id", F.floor(F.col("at") / F.col("w")).alias("y"), (F.col("at") % F.col("w")).alias("x"), "v")


@query("SELECT s.image_id, s.y, s.x, CASE WHEN h.y IS NULL THEN s.v ELSE 77 END AS v FROM stripes s LEFT JOIN hit h USING (image_id, y, x)", _SMALL)
def draw_boxes(spark, sf_dir):
    """The frames' borders, two pixels wide, on the stripes."""
    return _pixels_of(drawing.paint(fx.images(spark, sf_dir, 1), drawing.box_spans(fx.frames(spark, sf_dir), 2), (77,)))


@query(
    """SELECT b.image_id, b.box_id, MAX(s.y) - MIN(s.y) + 1 AS height, MAX(s.x) - MIN(s.x) + 1 AS width, CAST(SUM(s.v) AS BIGINT) AS total
    FROM frames b JOIN stripes s ON s.image_id = b.image_id AND s.y >= b.y1 - 2 AND s.y < b.y2 + 2 AND s.x >= b.x1 - 2 AND s.x < b.x2 + 2 GROUP BY ALL"""
)
def clip_pictures(spark, sf_dir):
    """The pictures of the frames on the stripes: sizes and sums of pixels."""
    clips = drawing.clippings(fx.images(spark, sf_dir, 1), fx.frames(spark, sf_dir)).withColumn("k", F.struct("image_id", "box_id"))
    sums = _pixels_of(clips.select(F.col("k").alias("image_id"), "width", "data")).groupBy("image_id").agg(F.sum("v").alias("total"))
    sizes = clips.select("k", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"))
    return sizes.join(sums, F.col("k") == F.col("image_id")).select("k.image_id", "k.box_id", "height", "width", "total")


@query("SELECT image_id, y, x, comp FROM labels", _BITS, recursive=True)
def cc_label(spark, sf_dir):
    return _labels(spark, sf_dir).select("image_id", "y", "x", "comp")


@query("SELECT image_id, y, x, comp FROM labels", _BITS, recursive=True)
def cc_label_tiles(spark, sf_dir):
    """cc_label by tiles of 8 x 8, so that no task holds an image."""
    return regions.label_tiles(fx.bits(spark, sf_dir), tile=8).select("image_id", "y", "x", "comp")


_MEASURES = "SELECT image_id, comp, MIN(x) AS x1, MIN(y) AS y1, MAX(x) AS x2, MAX(y) AS y2, COUNT(*) AS n_pixels, MAX(x) - MIN(x) + 1 AS width, MAX(y) - MIN(y) + 1 AS height FROM labels GROUP BY ALL"


@query(_MEASURES, _BITS, recursive=True)
def cc_bbox(spark, sf_dir):
    return regions.measure(_labels(spark, sf_dir))


_SIDES = "SELECT image_id, comp, 'column' AS side, x AS at, MIN(y) AS lo, MAX(y) AS hi FROM labels GROUP BY ALL UNION ALL SELECT image_id, comp, 'row', y, MIN(x), MAX(x) FROM labels GROUP BY image_id, comp, y"


@query(_SIDES, _BITS, recursive=True)
def cc_boundary(spark, sf_dir):
    return regions.boundary(_labels(spark, sf_dir))


@query(
    f"SELECT image_id, comp, MAX(thin) > 0.93 AS is_line FROM (SELECT image_id, comp, side, AVG(CASE WHEN hi - lo <= 8 THEN 1.0::DOUBLE ELSE 0 END) AS thin FROM ({_SIDES}) GROUP BY ALL) GROUP BY ALL",
    _BITS,
    recursive=True,
)
def cc_line(spark, sf_dir):
    return regions.lines(_labels(spark, sf_dir))


@query("SELECT image_id, comp, COUNT(*) AS n_pixels FROM labels GROUP BY ALL HAVING COUNT(*) >= 4", _BITS, recursive=True)
def cc_size(spark, sf_dir):
    return regions.large(_labels(spark, sf_dir), 4)


@query("SELECT image_id, comp, MIN(y * 100 + x) // 100 AS seed_y, MIN(y * 100 + x) % 100 AS seed_x FROM labels WHERE y % 5 = 0 AND x >= y % 2 AND (x - y % 2) % 2 = 0 GROUP BY ALL", _BITS, recursive=True)
def cc_seeded(spark, sf_dir):
    return regions.seeded(_labels(spark, sf_dir))


@query(
    f"SELECT DISTINCT image_id, comp, CASE side WHEN 'column' THEN e ELSE \"at\" END AS y, CASE side WHEN 'column' THEN \"at\" ELSE e END AS x, 255::BIGINT AS v FROM (SELECT *, unnest([lo, hi]) AS e FROM ({_SIDES}))",
    _BITS,
    recursive=True,
)
def cc_outline(spark, sf_dir):
    return regions.outlines(_labels(spark, sf_dir))


@query()
def nested_areas(spark, sf_dir):
    return regions.nested_areas(fx.panels(spark, sf_dir))


@query()
def image_rectangles(spark, sf_dir):
    p = fx.panels(spark, sf_dir)
    whole = {"box_id": 1, "x1": 0, "y1": 0, "x2": 2 * fx.SIDE, "y2": 2 * fx.SIDE}
    return regions.rectangles_in_images(p.select("image_id", "y", "x", "v", *[F.lit(v).cast("long").alias(k) for k, v in whole.items()]))


#: Depths along the four borders of each region, against the point behind the corner or behind the last great outward step.
_BORDERS = f"""
sides AS ({_SIDES}),
borders AS (
  SELECT image_id, comp, border, outwards, "at" - MIN("at") OVER b AS i, v, lead(v) OVER (b ORDER BY "at") AS beyond, COUNT(*) OVER b AS n FROM (
    SELECT image_id, comp, "at", CASE side WHEN 'column' THEN 'top' ELSE 'left' END AS border, 1 AS outwards, lo AS v FROM sides
    UNION ALL SELECT image_id, comp, "at", CASE side WHEN 'column' THEN 'bottom' ELSE 'right' END, -1, hi FROM sides) WINDOW b AS (PARTITION BY image_id, comp, border)),
sizes AS (SELECT image_id, comp, MAX(x) - MIN(x) + 1 AS width, MAX(y) - MIN(y) + 1 AS height FROM labels GROUP BY ALL),
points AS (
  SELECT *, CASE WHEN border IN ('top', 'bottom') THEN height ELSE width END AS across FROM borders JOIN sizes USING (image_id, comp)
  WHERE i >= floor(3 + n * 0.02::DOUBLE) AND i < n - 1),
steps AS (SELECT *, i < 0.08::DOUBLE * n AND outwards * (v - beyond) > 0.5::DOUBLE * across AS great FROM points),
depths AS (
  SELECT *, COALESCE(last_value(CASE WHEN great THEN beyond END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(v) OVER w) - beyond AS depth
  FROM steps WINDOW w AS (PARTITION BY image_id, comp, border ORDER BY i)),
kinds AS (SELECT *, abs(depth) > 0.3::DOUBLE * across AS far, abs(depth) > 0.15::DOUBLE * across AND outwards * depth < 0 AS sunken FROM depths),
runs AS (SELECT image_id, comp, border, n, COUNT(*) AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY image_id, comp, border ORDER BY i) AS run FROM kinds WHERE far) GROUP BY image_id, comp, border, n, run),
bad AS (
  SELECT image_id, comp FROM runs WHERE size > 0.1::DOUBLE * n
  UNION SELECT image_id, comp FROM kinds GROUP BY image_id, comp, border, n HAVING COUNT(*) FILTER (sunken AND NOT far) > 0.25::DOUBLE * n),
level AS (SELECT image_id, comp, COUNT(*) AS n_level FROM kinds WHERE NOT far AND NOT sunken AND abs(depth) < 1 + 0.015::DOUBLE * across GROUP BY ALL)"""


@query(
    """SELECT s.image_id, s.comp, (s.image_id, s.comp) NOT IN (SELECT (image_id, comp) FROM bad)
      AND COALESCE(n_level, 0) / (2 * (width + height)) >= CASE WHEN height / 32 > 0.3 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS is_rectangle
    FROM sizes s LEFT JOIN level l ON s.image_id = l.image_id AND s.comp = l.comp""",
    _BITS + "," + _BORDERS,
    recursive=True,
)
def cc_rectangle(spark, sf_dir):
    return regions.rectangles(_labels(spark, sf_dir), fx.SIDE)


@query(_MEASURES + " HAVING COUNT(*) >= 6", _REGIONS.format("raster", 5), recursive=True)
def nested_regions(spark, sf_dir):
    return regions.even_areas(fx.raster(spark, sf_dir), 5, 6)


@query(
    """SELECT f.image_id, f.box_id, COALESCE(MAX(s.n), 0) <= 2 AS is_block FROM frames f LEFT JOIN (
      SELECT image_id, box_id, side, COUNT(*) AS n FROM lines WHERE n_on > 0.15 * length GROUP BY ALL) s USING (image_id, box_id) GROUP BY ALL""",
    """
inner_pixels AS (
  SELECT f.image_id, f.box_id, p.y - f.y1 AS dy, p.x - f.x1 AS dx, f.y2 - f.y1 AS h, f.x2 - f.x1 AS w FROM frames f JOIN stripes p
    ON p.image_id = f.image_id AND p.v > 0 AND p.x >= f.x1 AND p.x < f.x2 AND p.y >= f.y1 AND p.y < f.y2),
lines AS (
  SELECT image_id, box_id, 1 AS side, dy AS at, w AS length, COUNT(*) AS n_on FROM inner_pixels WHERE dy BETWEEN 5 AND 8 GROUP BY ALL
  UNION ALL SELECT image_id, box_id, 2, dy, w, COUNT(*) FROM inner_pixels WHERE dy BETWEEN h - 8 AND h - 5 GROUP BY ALL
  UNION ALL SELECT image_id, box_id, 3, dx, h, COUNT(*) FROM inner_pixels WHERE dx BETWEEN 5 AND 8 GROUP BY ALL
  UNION ALL SELECT image_id, box_id, 4, dx, h, COUNT(*) FROM inner_pixels WHERE dx BETWEEN w - 8 AND w - 5 GROUP BY ALL)""",
)
def block_flag(spark, sf_dir):
    return regions.blocks(fx.stripes(spark, sf_dir), fx.frames(spark, sf_dir), fx.SIDE, fx.SIDE)


# vectors


def _parts(rows: DataFrame, vec, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(vec).alias("i", "y")).select(*keep, F.col("i").cast("long").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


@query("SELECT p.vec_id, p.i, round(p.x / sqrt(n.m + 1e-6), 6) + 0.0 AS y FROM parts p JOIN (SELECT vec_id, SUM(x * x) / COUNT(*) AS m FROM parts GROUP BY ALL) n USING (vec_id)")
def vec_rmsnorm(spark, sf_dir):
    return _parts(fx.vectors(spark, sf_dir), vectors.rms_norm(F.col("vec")), "vec_id")


@query("SELECT vec_id, (i + 32) % 64 AS i, round(CASE WHEN i >= 32 THEN -x ELSE x END, 6) + 0.0 AS y FROM parts")
def vec_rotate_half(spark, sf_dir):
    return _parts(fx.vectors(spark, sf_dir), vectors.rotate_half(F.col("vec")), "vec_id")


_TURN = """SELECT a.vec_id, a.i, round(a.x * cos(t.t) + CASE WHEN a.i < 32 THEN -b.x ELSE b.x END * sin(t.t), 6) + 0.0 AS y
  FROM parts a JOIN parts b ON a.vec_id = b.vec_id AND b.i = (a.i + 32) % 64 JOIN turn t ON t.vec_id = a.vec_id AND t.i = a.i"""


@query(_TURN, "\nturn AS (SELECT vec_id, i, pos * pow(1e6::DOUBLE, -2.0::DOUBLE * (i % 32) / 64) AS t FROM parts)")
def vec_rope_1d(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    return _parts(v, vectors.rotate(F.col("vec"), vectors.angles_1d(F.col("pos"), 64, 1e6)), "vec_id")


@query(_TURN, "\nturn AS (SELECT vec_id, i, CASE WHEN i < 32 THEN pos // 16 % 16 ELSE pos % 16 END * pow(1e4::DOUBLE, -2.0::DOUBLE * (i % 16) / 32) AS t FROM parts)")
def vec_rope_2d(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    angles = vectors.angles_2d(F.floor(F.col("pos") / 16) % 16, F.col("pos") % 16, 64)
    return _parts(v, vectors.rotate(F.col("vec"), angles), "vec_id")


def _rows(spark, sf_dir) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", vectors.doubles(F.col("embedding")).alias("vec"))


def _numbered(name: str, *shape: int):
    """The formula's matrices with one number each; a bias for none."""
    layers = {"linear.weight": 1, "gate_proj.weight": 1, "up_proj.weight": 2, "down_proj.weight": 3}
    return kernels.formula_weights(*shape, layers[name]) if name in layers else None


def _gated(x):
    """A gated unit from 64 numbers over 24 to 8."""
    inner = kernels.silu(models.linear(x, _numbered, "gate_proj", 24)) * models.linear(x, _numbered, "up_proj", 24)
    return models.linear(inner, _numbered, "down_proj", 8)


_W = "((o * 31 + i * 17 + {0} * 7) % 13 - 6) / 64.0::DOUBLE"


@query(f"SELECT vec_id, o AS i, round(SUM(x * {_W.format(1)}), 6) + 0.0 AS y FROM parts, (SELECT range AS o FROM range(16)) GROUP BY vec_id, o")
def vec_linear(spark, sf_dir):
    return _parts(models.linear_vectors(_rows(spark, sf_dir), "vec_id", 16, "linear", _numbered), F.col("vec"), "vec_id")


@query(
    f"SELECT vec_id, o AS i, round(SUM(z * {_W.format(3)}), 6) + 0.0 AS y FROM hidden, (SELECT range AS o FROM range(8)) GROUP BY vec_id, o",
    f"""
gates AS (SELECT vec_id, o, SUM(x * {_W.format(1)}) AS g, SUM(x * {_W.format(2)}) AS u FROM parts, (SELECT range AS o FROM range(24)) GROUP BY vec_id, o),
hidden AS (SELECT vec_id, o AS i, g / (1 + exp(-g)) * u AS z FROM gates)""",
)
def vec_swiglu(spark, sf_dir):
    return _parts(models.map_vectors(_rows(spark, sf_dir), "vec_id", _gated), F.col("vec"), "vec_id")


@query(
    """SELECT image_id, box_id, r.range * 16 + c.range AS patch FROM boxes JOIN range(16) r ON r.range * 600 >= y1 * 15 AND r.range * 600 <= y2 * 15
    JOIN range(16) c ON c.range * 800 >= x1 * 15 AND c.range * 800 <= x2 * 15""",
)
def box_mask(spark, sf_dir):
    return sequences.box_mask(fx.boxes(spark, sf_dir), 16, fx.WIDTH, fx.HEIGHT)


def _attention_sql(kv_heads: int) -> str:
    return f"""
scores AS (
  SELECT q.seq, q.pos AS qpos, k.pos AS kpos, q.i // 16 AS head, SUM(q.x * k.x) / 4 AS s FROM parts q JOIN parts k
    ON q.seq = k.seq AND k.pos <= q.pos AND k.i = q.i // 16 // (4 // {kv_heads}) * 16 + q.i % 16 GROUP BY ALL),
shares AS (SELECT seq, qpos, kpos, head, exp(s - MAX(s) OVER w) AS e FROM scores WINDOW w AS (PARTITION BY seq, qpos, head)),
outs AS (
  SELECT s.seq, s.qpos AS pos, s.head, v.i % 16 AS i, SUM(s.e * v.x) / SUM(s.e) AS o FROM shares s JOIN parts v
    ON v.seq = s.seq AND v.pos = s.kpos AND v.i // 16 = s.head // (4 // {kv_heads}) GROUP BY ALL)"""


_OUT = "SELECT seq, pos, CAST(head AS INTEGER) AS head, i, round(o, 6) + 0.0 AS y FROM outs"


@query(_OUT, _attention_sql(4))
def attn_masked(spark, sf_dir):
    return _parts(sequences.attention(fx.vectors(spark, sf_dir), 4), F.col("out"), "seq", "pos", "head")


@query(_OUT, _attention_sql(2))
def attn_gqa(spark, sf_dir):
    return _parts(sequences.attention(fx.vectors(spark, sf_dir), 4, 2), F.col("out"), "seq", "pos", "head")


@query(_OUT, _attention_sql(2))
def attn_spread(spark, sf_dir):
    """attn_gqa with each sequence over many tasks: a task per block of queries and chunk of keys, whose results merge."""
    return _parts(sequences.attention(fx.vectors(spark, sf_dir), 4, 2, spread_from=32, query_block=16, key_chunk=48), F.col("out"), "seq", "pos", "head")


@query(
    """SELECT v.label AS image_id, v.vec_id AS box_idx, CAST(s.range AS INTEGER) AS slot, CASE s.range WHEN 0 THEN v.vec_id WHEN 1 THEN e.lo ELSE e.hi END AS source
    FROM vectors v JOIN (SELECT label, MIN(vec_id) AS lo, MAX(vec_id) AS hi FROM vectors GROUP BY ALL) e USING (label) CROSS JOIN range(3) s""",
)
def triples(spark, sf_dir):
    t = _triples(spark, sf_dir)
    return t.select("image_id", "box_idx", "slot", F.col("vec.source").alias("source"))


def _triples(spark, sf_dir) -> DataFrame:
    """A triple for each vector: itself, its label's first and its label's last vector."""
    e = fx.table(spark, sf_dir, "embeddings")
    one = F.struct(F.col("vec_id").alias("source"), vectors.doubles(F.col("embedding")).alias("x"))
    rows = e.select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("box_idx"), one.alias("vec"))
    ends = rows.groupBy("image_id").agg(F.min_by("vec", "box_idx").alias("lo"), F.max_by("vec", "box_idx").alias("hi"))
    return sequences.triples(rows, ends.select("image_id", F.col("lo").alias("vec")), ends.select("image_id", F.col("hi").alias("vec")))


#: Models in SQL: tokens are rows (s, t, i, x): sequence, position, place in the vector, number.


def _linear_sql(name: str, source: str, out: int, layer: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT s, t, o AS i, SUM(x * {_W.format(layer)}) AS x FROM {source}, (SELECT range AS o FROM range({out})) GROUP BY s, t, o)"


def _norm_sql(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT s, t, i, x / sqrt(m + 1e-6) AS x FROM {source} JOIN (SELECT s, t, SUM(x * x) / COUNT(*) AS m FROM {source} GROUP BY s, t) USING (s, t))"


def _turn_sql(name: str, source: str, each: int, angle: str) -> str:
    """angle: of the position t and the place j in a head of `each` numbers."""
    half = each // 2
    return f"""{name} AS MATERIALIZED (
  SELECT a.s, a.t, a.i, a.x * cos(a.g) + CASE WHEN a.j < {half} THEN -b.x ELSE b.x END * sin(a.g) AS x
  FROM (SELECT *, {angle} AS g FROM (SELECT *, i % {each} AS j FROM {source})) a JOIN {source} b ON a.s = b.s AND a.t = b.t AND b.i = a.i - a.j + (a.j + {half}) % {each})"""


def _heads_sql(name: str, of: str, each: int, group: int, allowed: str) -> str:
    """Attention of {of}q, {of}k, {of}v; allowed: of the positions q.t and k.t."""
    return f"""{name}_scores AS MATERIALIZED (
  SELECT q.s, q.t, k.t AS u, q.i // {each} AS h, SUM(q.x * k.x) / sqrt({each}) AS x FROM {of}q q JOIN {of}k k ON q.s = k.s AND k.i = q.i // {each * group} * {each} + q.i % {each} AND {allowed} GROUP BY ALL),
{name}_shares AS MATERIALIZED (SELECT s, t, u, h, exp(x - MAX(x) OVER (PARTITION BY s, t, h)) AS e FROM {name}_scores),
{name} AS MATERIALIZED (
  SELECT e.s, e.t, e.h * {each} + v.i % {each} AS i, SUM(e.e * v.x) / SUM(e.e) AS x FROM {name}_shares e JOIN {of}v v ON v.s = e.s AND v.t = e.u AND v.i // {each} = e.h // {group} GROUP BY ALL)"""


def _layers_sql(name: str, source: str, depth: int, first: int, dim: int, heads: int, kv_heads: int, mlp: int, angle: str, allowed: str) -> str:
    """name: the tokens of `source` after the layers and a last norm; matrices from layer `first` on, ten a layer."""
    made, each = [], dim // heads
    for d in range(depth):
        n, at = f"{name}{d}_", first + 10 * d
        made += [_norm_sql(f"{n}a", source), _linear_sql(f"{n}p", f"{n}a", dim, at), _linear_sql(f"{n}r", f"{n}a", each * kv_heads, at + 1), _linear_sql(f"{n}v", f"{n}a", each * kv_heads, at + 2)]
        made += [_turn_sql(f"{n}q", f"{n}p", each, angle), _turn_sql(f"{n}k", f"{n}r", each, angle), _heads_sql(f"{n}o", n, each, heads // kv_heads, allowed), _linear_sql(f"{n}w", f"{n}o", dim, at + 3)]
        made += [f"{n}b AS MATERIALIZED (SELECT a.s, a.t, a.i, a.x + b.x AS x FROM {source} a JOIN {n}w b USING (s, t, i))", _norm_sql(f"{n}c", f"{n}b")]
        made += [_linear_sql(f"{n}g", f"{n}c", mlp, at + 4), _linear_sql(f"{n}u", f"{n}c", mlp, at + 5), f"{n}z AS MATERIALIZED (SELECT g.s, g.t, g.i, g.x / (1 + exp(-g.x)) * u.x AS x FROM {n}g g JOIN {n}u u USING (s, t, i))"]
        made += [_linear_sql(f"{n}d", f"{n}z", dim, at + 6), f"{n}e AS MATERIALIZED (SELECT a.s, a.t, a.i, a.x + b.x AS x FROM {n}b a JOIN {n}d b USING (s, t, i))"]
        source = f"{n}e"
    return ",\n".join([*made, _norm_sql(name, source)])


def _project_sql(name: str, source: str, hidden: int, out: int) -> str:
    """The error function as its series exp(-y * y) * sum of y ** (2 n + 1) / gamma(n + 3/2)."""
    y = "(x / sqrt(2.0::DOUBLE))"
    erf = f"exp(-{y} * {y}) * list_sum(list_transform(range(0, 120), lambda n: pow({y}, 2 * n + 1) / gamma(n + 1.5::DOUBLE)))"
    return ",\n".join([_linear_sql(f"{name}_hidden", source, hidden, 0), f"{name}_bent AS MATERIALIZED (SELECT s, t, i, x * 0.5 * (1 + {erf}) AS x FROM {name}_hidden)", _linear_sql(name, f"{name}_bent", out, 1)])


def _encoder_sql(name: str, patches: str, boxes_: str, depth: int, n_boxes: str) -> str:
    """name: tokens (0 global, then n_boxes boxes) of patches (s, t from 0, i, x) and boxes (s, n from 1, x1 .. y2), 4 x 4 patches, 32 wide, 4 heads."""
    angle = f"CASE WHEN t <= {n_boxes} THEN 0 WHEN j < 4 THEN (t - 1 - {n_boxes}) // 4 ELSE (t - 1 - {n_boxes}) % 4 END * pow(1e4::DOUBLE, -2.0::DOUBLE * (j % 2) / 4)"
    seen = f"EXISTS (SELECT 1 FROM {boxes_} b WHERE b.s = q.s AND b.n = q.t AND (k.t - 1 - {n_boxes}) // 4 BETWEEN b.y1 * 3 AND b.y2 * 3 AND (k.t - 1 - {n_boxes}) % 4 BETWEEN b.x1 * 3 AND b.x2 * 3)"
    allowed = f"(q.t NOT BETWEEN 1 AND {n_boxes} OR k.t IN (0, q.t) OR k.t > {n_boxes} AND {seen})"
    tokens = f"""{_linear_sql(f"{name}_patches", patches, 32, 0)},
{name}_tokens AS MATERIALIZED (
  SELECT s, t + 1 + {n_boxes} AS t, i, x FROM {name}_patches
  UNION ALL SELECT s, n.range, i.range, 0.0::DOUBLE FROM (SELECT DISTINCT s FROM {patches}), range(1 + {n_boxes}) n, range(32) i)"""
    return tokens + ",\n" + _layers_sql(name, f"{name}_tokens", depth, 1, 32, 4, 4, 128, angle, allowed)


def _fuser_sql(name: str, source: str, layers: int) -> str:
    return _layers_sql(name, source, layers, 0, 64, 4, 2, 128, "t * pow(1e6::DOUBLE, -2.0::DOUBLE * (j % 8) / 16)", "k.t <= q.t")


@query("SELECT s AS vec_id, i, round(x, 6) + 0.0 AS y FROM projected", "tokens AS (SELECT vec_id AS s, 0 AS t, i, x FROM parts),\n" + _project_sql("projected", "tokens", 32, 8))
def vec_gelu_projector(spark, sf_dir):
    return _parts(models.project_vectors(_rows(spark, sf_dir), "vec_id", 32, 8), F.col("vec"), "vec_id")


_SIXTEENS = """
patches AS MATERIALIZED (
  SELECT g.s, g.t, g.i, COALESCE(p.x, 0.0::DOUBLE) AS x
  FROM (SELECT s, t.range AS t, i.range AS i FROM (SELECT DISTINCT label * 1000000 + pos // 16 AS s FROM vectors), range(16) t, range(64) i) g
  LEFT JOIN (SELECT label * 1000000 + pos // 16 AS s, pos % 16 AS t, i, x FROM parts) p USING (s, t, i)),
two AS MATERIALIZED (
  SELECT DISTINCT s, n, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM patches, (VALUES (1, 0.1, 0.1, 0.7, 0.4), (2, 0.0, 0.0, 1.0, 1.0)) b(n, x1, y1, x2, y2)),
"""


@query("SELECT s AS image_id, CAST(t AS INTEGER) AS tok, i, round(x, 6) + 0.0 AS y FROM encoded WHERE t <= 2", _SIXTEENS + _encoder_sql("encoded", "patches", "two", 2, "2"))
def encoder_forward(spark, sf_dir):
    """Every 16 vectors of a label that follow one another as the patches of an image, with two boxes; zero patches fill up a label's last image."""
    at = (F.col("label") * 1000000 + F.floor(F.col("pos") / 16)).alias("image_id")
    v = fx.vectors(spark, sf_dir).groupBy(at).agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("p"))
    two = F.array(F.array(*map(F.lit, (0.1, 0.1, 0.7, 0.4))), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), 64), 16 - F.size("p"))
    images_ = v.select("image_id", F.concat("p.vec", blank).alias("patches"), two.alias("boxes"))
    return _parts(models.encode_images(images_), F.col("vec"), "image_id", "tok")


_TRIPLES = """
triples AS MATERIALIZED (
  SELECT v.label * 1000000000 + v.vec_id AS s, k.range AS t, p.i, p.x FROM vectors v JOIN (SELECT label, MIN(vec_id) AS lo, MAX(vec_id) AS hi FROM vectors GROUP BY ALL) e USING (label) CROSS JOIN range(3) k
  JOIN parts p ON p.vec_id = CASE k.range WHEN 0 THEN v.vec_id WHEN 1 THEN e.lo ELSE e.hi END),
"""


@query("SELECT s // 1000000000 AS image_id, s % 1000000000 AS box_idx, i, round(x, 6) + 0.0 AS y FROM fused WHERE t = 2", _TRIPLES + _fuser_sql("fused", "triples", 2))
def fuser_forward(spark, sf_dir):
    t = _triples(spark, sf_dir).select("image_id", "box_idx", "slot", F.col("vec.x").alias("vec"))
    return _parts(models.fuse_triples(t), F.col("vec"), "image_id", "box_idx")


@query("SELECT s // 1000000000 AS image_id, s % 1000000000 AS box_idx, i, round(x, 6) + 0.0 AS y FROM fused WHERE t = 2", _TRIPLES + _fuser_sql("fused", "triples", 2))
def fuser_tiled(spark, sf_dir):
    """The fuser with its matrices as rows of tiles that are smaller than any of them and don't meet its heads."""
    t = _triples(spark, sf_dir).select("image_id", "box_idx", "slot", F.col("vec.x").alias("vec"))
    return _parts(tiled.fuse_triples(t, tile=24), F.col("vec"), "image_id", "box_idx")


_IMAGES = """
patches AS MATERIALIZED (SELECT image_id AS s, y // 8 * 4 + x // 8 AS t, y % 8 * 8 + x % 8 AS i, CAST(v AS DOUBLE) AS x FROM raster),
corners AS MATERIALIZED (SELECT image_id AS s, box_id + 1 AS n, least(x1 / 32.0::DOUBLE, 1) AS x1, least(y1 / 32.0::DOUBLE, 1) AS y1, least(x2 / 32.0::DOUBLE, 1) AS x2, least(y2 / 32.0::DOUBLE, 1) AS y2 FROM frames),
"""
_FUSED = """,
slots AS MATERIALIZED (
  SELECT b.s * 4 + b.t - 1 AS s, k.range AS t, p.i, p.x FROM (SELECT DISTINCT s, t FROM projected WHERE t > 0) b, range(2) k JOIN projected p ON p.s = b.s AND p.t = CASE k.range WHEN 0 THEN b.t ELSE 0 END
  UNION ALL SELECT b.s * 4 + b.t - 1, 2, p.i, p.x FROM (SELECT DISTINCT s, t FROM projected WHERE t > 0) b JOIN parts p ON p.pos = 0 AND p.label = b.s % 10),
"""


@query(
    "SELECT s // 4 AS image_id, s % 4 AS box_idx, i, round(x, 6) + 0.0 AS y FROM fused WHERE t = 2",
    _IMAGES + _encoder_sql("encoded", "patches", "corners", 1, "4") + ",\nwanted AS (SELECT * FROM encoded WHERE t <= 4),\n" + _project_sql("projected", "wanted", 48, 64) + _FUSED + _fuser_sql("fused", "slots", 1),
)
def embed_boxes(spark, sf_dir):
    """Images, boxes and texts to one vector per box: the rasters as 16 patches of 8 x 8, their frames, the first vector of label image_id % 10 as text."""
    p = embed.patches(fx.raster(spark, sf_dir), 8, fx.SIDE)
    f = fx.frames(spark, sf_dir).withColumn("box", F.array(*[F.least(F.col(c) / F.lit(float(fx.SIDE)), F.lit(1.0)) for c in ("x1", "y1", "x2", "y2")]))
    boxes_ = f.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "box"))).alias("b")).select("image_id", F.col("b.box").alias("boxes"))
    firsts = fx.vectors(spark, sf_dir).filter("pos = 0").select("label", "vec")
    texts = p.select("image_id", (F.col("image_id") % 10).alias("label")).join(firsts, "label").select("image_id", "vec")
    small = models.EncoderConfig(side=4, patch=64, dim=32, heads=4, depth=1)
    return _parts(embed.embed(p.join(boxes_, "image_id"), texts, small, models.FuserConfig(layers=1), 48), F.col("vec"), "image_id", "box_idx")


@query()
def detect_boxes(spark, sf_dir):
    """The detector over the stripes as images, each pixel as an 8 x 8 square."""
    found = spread.detect(fx.images(spark, sf_dir), tile=128)
    return found.select("image_id", "box_idx", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query()
def detect_spread(spark, sf_dir):
    """The same with squares of 4 x 4 and small tiles."""
    found = spread.detect(fx.images(spark, sf_dir, 4), tile=32)
    return found.select("image_id", "box_idx", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


# results


@query('SELECT image_id, box_id AS id, category, x1 AS column_min, y1 AS row_min, x2 AS column_max, y2 AS row_max, x2 - x1 AS width, y2 - y1 AS height FROM categorised')
def result_json_roundtrip(spark, sf_dir):
    return results.from_documents(results.to_documents(fx.categorised(spark, sf_dir), fx.WIDTH, fx.HEIGHT))


def _shares_sql(name: str) -> str:
    """Of each of 20 new places between 32 old ones: the places on both sides and their shares of 2048, from the centre (2 k + 1) * 32 / 40 - 1 / 2."""
    return f"""
{name}_at AS (SELECT range AS k, (range + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE AS c FROM range(20)),
{name}_between AS (SELECT k, CAST(floor(c) AS BIGINT) AS lo, CASE WHEN floor(c) < 0 OR floor(c) >= 31 THEN 0 ELSE c - floor(c) END AS f FROM {name}_at),
{name}_shares AS (
  SELECT k, greatest(0, least(31, lo)) AS p, CAST(round_even((1 - f) * 2048, 0) AS BIGINT) AS s FROM {name}_between
  UNION ALL SELECT k, greatest(0, least(31, greatest(lo, 0) + 1)), 2048 - CAST(round_even((1 - f) * 2048, 0) AS BIGINT) FROM {name}_between)"""


@query(
    "SELECT image_id, j.k AS y, x, (SUM((j.s * (a.v // 16)) // 65536) + 2) // 4 AS v FROM across a JOIN row_shares j ON j.p = a.y GROUP BY ALL",
    _shares_sql("row") + "," + _shares_sql("column") + """,
across AS (SELECT image_id, y, c.k AS x, CAST(SUM(c.s * v) AS BIGINT) AS v FROM raster r JOIN column_shares c ON c.p = r.x GROUP BY ALL)""",
)
def px_resize(spark, sf_dir):
    return images.resize(fx.raster(spark, sf_dir), fx.SIDE, fx.SIDE, 20)


@query(
    """SELECT image_id, y, x, list_sort(list(v))[5] AS v FROM (
      SELECT p.image_id, p.y, p.x, q.v FROM raster p, range(-1, 2) dy, range(-1, 2) dx JOIN raster q
        ON q.image_id = p.image_id AND q.y = greatest(0, least(31, p.y + dy.range)) AND q.x = greatest(0, least(31, p.x + dx.range))) GROUP BY ALL""",
)
def px_median(spark, sf_dir):
    return pixels.median(fx.raster(spark, sf_dir), 3)


@query(
    """SELECT image_id, y, x, list_sort(list(v))[25] AS v FROM (
      SELECT p.image_id, p.y, p.x, q.v FROM raster p, range(-3, 4) dy, range(-3, 4) dx JOIN raster q
        ON q.image_id = p.image_id AND q.y = greatest(0, least(31, p.y + dy.range)) AND q.x = greatest(0, least(31, p.x + dx.range))) GROUP BY ALL""",
)
def px_median_wide(spark, sf_dir):
    return pixels.median(fx.raster(spark, sf_dir), 7, tile=20)


__all__ = ["QUERIES", "ORACLE_SQL"]

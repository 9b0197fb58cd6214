"""Work that must not land in one task, or be sent to all, as tables grow."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boxes, kernels, merging, models, regions, vectors
from gridloom.plans import detect, spread
from gridloom.plans import fixtures as fx
from gridloom.plans import registry

SF = "/root/testdata/sf0.01"


def test_rasters_and_panels_are_made_by_many_tasks(spark):
    for made in (fx.panels(spark, SF), fx.raster(spark, SF)):
        assert made.select(F.spark_partition_id()).distinct().count() > 1


def test_regions_of_a_tile_are_rows_with_borders(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 2, (40, 50)) * 90
    v[5:30, 8:41] = 200
    rows = [(1, y, x, int(v[y, x])) for y in range(40) for x in range(50)]
    frame = spark.createDataFrame(rows, "image_id long, y long, x long, v long")
    assert regions.pieces(frame, 5, (10, 10), 300).count() == 1  # small regions inside a tile are no rows
    labels = kernels.label(v, np.ones(v.shape, bool), 5)
    want = {k: r for k, r in kernels.regions(labels).items()}
    for tile in (16, 64):
        parts = regions.united(regions.pieces(frame, 5, (10, 10), 0, tile), 5)
        got = regions.measured(parts).collect()
        assert sorted((r.x1, r.y1, r.x2, r.y2, r.n_pixels) for r in got) == sorted((r.x1, r.y1, r.x2, r.y2, r.n) for r in want.values())
        borders = regions.united_borders(parts, regions.measured(parts)).collect()
        key = lambda *sides: tuple(tuple(int(x) for x in s) for s in sides)
        assert sorted(key(r.top, r.bottom, r.left, r.right) for r in borders) == sorted(key(r.top, r.bottom, r.left, r.right) for r in want.values())


def test_nested_areas_and_rectangles_need_no_row_per_labelled_pixel(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a row per pixel")

    monkeypatch.setattr(regions, "label_tiles", refused)
    v = np.full((60, 60), 255)
    v[10:50, 10:45] = 0
    rows = [(1, 1, 0, 0, 60, 60, y, x, int(v[y, x])) for y in range(60) for x in range(60)]
    frame = spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long, y long, x long, v long")
    assert [tuple(r)[2:] for r in regions.rectangles_in_images(frame, tile=16).collect()] == [(10, 10, 44, 49)]
    found = regions.nested_areas(frame.select("image_id", "y", "x", "v"), tile=16).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in found] == [(10, 10, 44, 49)]


def test_the_detector_has_a_row_per_tile(spark):
    v = np.zeros((70, 130, 1), np.uint8)
    v[20:60, 30:100] = 200
    images = spark.createDataFrame([(5, 70, 130, 1, bytearray(v.tobytes()))], "image_id long, height int, width int, channels int, data binary")
    found = spread.tiles(images, tile=64).collect()
    assert sorted((r.ty, r.tx, r.h, r.w, len(r.gray), len(r.bits)) for r in found) == [(ty, tx, h, w, h * w, -(-h * w // 8)) for ty, h in ((0, 64), (1, 6)) for tx, w in ((0, 64), (1, 64), (2, 2))]
    assert sorted(map(tuple, spread.detect(images, tile=64).collect())) == sorted(map(tuple, detect.detect(images).collect()))


def test_attention_sends_rows_a_bounded_number_of_times(spark):
    rows = spark.range(800).selectExpr("1L seq", "id pos", "array(1.0d) vec", "799L last")
    for of in vectors._panels(rows, False, 2, 5):
        assert of.count() <= 800 * 8


def test_merges_and_batches_are_taken_in_parts(spark, monkeypatch):
    rows = [(i, b, 10 * b, 0, 10 * b + 5 + i % 7, 9) for i in range(30) for b in range(i % 4 + 1)]
    frame = spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long").coalesce(1)
    want = sorted(map(tuple, merging.merge_close(frame).collect()))
    monkeypatch.setattr(merging, "TOGETHER", 3)
    assert sorted(map(tuple, merging.merge_close(frame).collect())) == want
    parts = list(models._cut([pa.record_batch({"a": list(range(7))})], models.TOGETHER // 3))
    assert [p.num_rows for p in parts] == [3, 3, 1]


def executed(df):
    """The plan as it ran, where an exchange that is used again is named by its first use."""
    df.collect()
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("== Initial Plan ==")[0]


def test_boxes_of_an_image_meet_without_a_row_per_cell(spark):
    for name in ("box_pairs_mixed", "box_containment", "box_drop_contained", "box_drop_inside_images", "box_relation"):
        plan = executed(registry.QUERIES[name](spark, SF))
        assert "sequence(" not in plan and "hashpartitioning(image_id" in plan, name
    assert executed(boxes.containment(fx.boxes(spark, SF))).count("+- Exchange ") == 1  # lines are dealt by image, nothing else moves


@pytest.mark.parametrize("most", (0, 20, 10**6))
def test_images_of_any_size_have_the_same_pairs(spark, monkeypatch, most):
    """Whole, over grids, or some this and some that way."""
    rng = np.random.default_rng(7)
    rows = []
    for image, n in ((1, 40), (2, 12), (3, 20), (4, 21), (5, 1)):
        for k in range(n):
            x, y, w, h = (int(v) for v in rng.integers((0, 0, 0, 0), (60, 60, 90, 30)))
            rows.append((image, k, x, y, x + w, y + h, ("Block", "Image", "Compo")[int(rng.integers(3))]))
    rows += [(image, 90 + k, *rows[0][2:6], "Block" if k == 1 else "Compo") for image in (1, 2) for k in range(3)]
    frame = spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long, category string")
    monkeypatch.setattr(boxes, "WHOLE", most)
    pairs = [(a, b, kernels.relation(a[2:6], b[2:6])) for a, b in itertools.combinations(sorted(rows), 2) if a[0] == b[0]]
    got = sorted((r.image_id, r.a_box_id, r.b_box_id, r.relation) for r in boxes.related_pairs(frame).collect())
    assert got == sorted((a[0], a[1], b[1], r) for a, b, r in pairs if r)
    want: dict = {}
    gone = set()
    for a, b, r in pairs:
        outer, inner = (b, a) if r == -1 else (a, b)
        if r in (-1, 1):
            want.setdefault(outer[:2], []).append(inner[1])
            gone |= {inner[:2]} if outer[6] != "Block" else set()
    assert {(r.image_id, r.box_id): r.contain for r in boxes.containment(frame).collect()} == {k: sorted(v) for k, v in want.items()}
    assert {(r.image_id, r.box_id) for r in boxes.drop_contained(frame).collect()} == {r[:2] for r in rows} - gone
    near = sorted((r.image_id, r.a_box_id, r.b_box_id) for r in boxes.near_pairs(frame, (3, 1)).collect())
    assert near == sorted((a[0], a[1], b[1]) for a, b, _ in pairs if max(a[2], b[2]) - 6 <= min(a[4], b[4]) and max(a[3], b[3]) - 2 <= min(a[5], b[5]))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kernels, pixels, regions


def test_line_traps():
    """Runs of line rows by (first, last): what is erased, from the scan's rules."""

    def erased(n, *runs):
        valid = [any(a <= i <= b for a, b in runs) for i in range(n)]
        return {i for a, b in kernels.line_erasures(valid) for i in range(a, b)}

    assert erased(30, (5, 7)) == {5, 6, 7}
    assert erased(30, (5, 12)) == set()  # eight rows are no thin line
    assert erased(40, (5, 7), (12, 14)) == {12, 13, 14}  # the second takes the first one's place
    # a band that is open when the wait ends is forgotten; its rest counts as a new run
    assert erased(50, (5, 6), (11, 22)) == {17, 18, 19, 20, 21, 22}
    assert erased(20, (17, 19)) == {17, 18}  # open at the end: all but the last row
    assert erased(20, (12, 14)) == {12, 13, 14}  # pending at the end
    assert erased(10) == set()


def test_runs_in_the_jvm_and_in_python(spark):
    rng = random.Random(3)
    cases = []
    for k in range(150):
        n, row, on = rng.randint(1, 60), [], rng.random() < 0.5
        while len(row) < n:
            row += [on] * rng.choice([1, 2, 3, 7, 8, 9, 10, 12])
            on = not on
        cases.append((k, row[:n]))
    rows = spark.createDataFrame([(k, y, v) for k, row in cases for y, v in enumerate(row)], "image_id long, y long, valid boolean")
    found = pixels.runs(rows).select("image_id", pixels.line_erasures(F.col("runs"), F.col("n")).alias("b"))
    got = {r.image_id: [(b.y0, b.y1 + 1) for b in r.b] for r in found.collect()}
    assert got == {k: kernels.line_erasures(v) for k, v in cases}


def test_gap_limit():
    row = np.ones(200, bool)
    row[50:55] = False
    assert kernels.is_line_row(row)
    row[55] = False
    assert not kernels.is_line_row(row)


def frame(spark, rasters):
    rows = [(i, y, x, int(v)) for i, a in rasters.items() for y, r in enumerate(a) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, v long")


def raster(df, i, shape):
    out = np.zeros(shape, int)
    for r in df.filter(f"image_id = {i}").collect():
        out[r.y, r.x] = r.v
    return out


def test_pixel_tables_are_the_kernels(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (14, 17))
    b = (rng.random((30, 20)) < 0.6) * 255
    b[3:5], b[20:22, :], b[27:30] = 255, 255, 255
    df = frame(spark, {1: a, 2: b})
    for saturate in (False, True):
        g = pixels.gradient(df, saturate)
        assert (raster(g, 1, a.shape) == kernels.gradient(a, saturate)).all()
    assert kernels.gradient(np.array([[0, 255], [255, 0]])).max() == 254  # 510 wraps
    for kernel in ((2, 1), (3, 3), (1, 2), (6, 7), (19, 8), (41, 30)):
        c = pixels.close_gaps(df, kernel)
        assert (raster(c, 2, b.shape) == kernels.close_gaps(b > 0, kernel) * 255).all()
    assert (raster(pixels.erase_lines(df), 2, b.shape) > 0).tolist() == kernels.erase_lines(b > 0).tolist()


def brute_labels(v, on, tolerance):
    h, w = v.shape
    out = -np.ones((h, w), int)
    for y in range(h):
        for x in range(w):
            if on[y, x] and out[y, x] < 0:
                todo, out[y, x] = [(y, x)], y * w + x
                while todo:
                    p, q = todo.pop()
                    for s, t in ((p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)):
                        if 0 <= s < h and 0 <= t < w and on[s, t] and out[s, t] < 0 and abs(int(v[s, t]) - int(v[p, q])) <= tolerance:
                            out[s, t] = y * w + x
                            todo.append((s, t))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_labels(seed):
    rng = np.random.default_rng(seed)
    v, on = rng.integers(0, 20, (23, 31)), rng.random((23, 31)) < 0.62
    for tolerance in (0, 4, 30):
        assert (kernels.label(v, on, tolerance) == brute_labels(v, on, tolerance)).all()


def test_corner_touch_and_lattice(spark):
    a = np.zeros((20, 20), int)
    a[0:4, 0:4] = a[4:8, 4:8] = 255  # they touch by a corner only
    a[11:15, 11:15] = 255  # between the seed rows 10 and 15
    df = regions.label(frame(spark, {1: a}).filter("v > 0"))
    assert df.select("comp").distinct().count() == 3
    assert regions.seeded(df).count() == 2
    assert [r.box for r in kernels.detect_regions(a > 0, 4)] == [(0, 0, 3, 3), (4, 4, 7, 7)]
    found = {(r.x1, r.y1, r.x2, r.y2, r.n_pixels, r.width) for r in regions.measure(df).collect()}
    assert (11, 11, 14, 14, 16, 4) in found


def shape(kind):
    a = np.zeros((60, 60), bool)
    y, x = np.mgrid[:60, :60]
    if kind == "disc":
        return (y - 30) ** 2 + (x - 30) ** 2 < 400
    a[10:50, 10:50] = True
    if kind == "notch":
        a[10:30, 22:38] = False
    if kind == "bar":
        a[:] = False
        a[10:14, 5:55] = True
    return a


def level_points(border, outwards, across, dent):
    """By following the border point by point."""
    n, level, sunken, far, longest = len(border), 0, 0, 0, 0
    reference = None
    for i in range(int(3 + n * 0.02), n - 1):
        here, beyond = int(border[i]), int(border[i + 1])
        reference = here if reference is None else reference
        if i / n < 0.08 and outwards * (here - beyond) > 0.5 * across:
            reference = beyond
        share = (reference - beyond) / across
        far = far + 1 if abs(share) > 0.3 else 0
        longest = max(longest, far)
        if not far:
            if abs(share) > 0.15 and outwards * share < 0:
                sunken += 1
            elif abs(reference - beyond) < 1 + across * 0.015:
                level += 1
    return None if longest > 0.1 * n or sunken > dent * n else level


def test_borders_against_brute_force():
    rng = np.random.default_rng(5)
    for k in range(2000):
        n = int(rng.integers(1, 90))
        border = [rng.integers(0, 9, n), np.where(rng.random(n) < 0.9, 5, rng.integers(0, 40, n)), np.where(np.arange(n) < rng.integers(0, n + 1), 3, 20)][k % 3]
        outwards, across = int(rng.choice([1, -1])), int(rng.integers(1, 50))
        assert kernels.flat_points(border, outwards, across, 0.25) == level_points(border, outwards, across, 0.25)


def test_rectangles_and_lines():
    made = {k: kernels.Region(*np.nonzero(shape(k))) for k in ("solid", "disc", "notch", "bar")}
    assert made["solid"].is_rectangle(60) and not made["notch"].is_rectangle(60) and not made["disc"].is_rectangle(60)
    assert made["bar"].is_line() and not made["solid"].is_line()


def test_borders_as_folds(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(300):
        h, w = int(rng.integers(1, 70)), int(rng.integers(1, 70))
        a = np.ones((h, w), bool)
        for _ in range(int(rng.integers(0, 4))):  # dents from above and from the left, that leave it in one piece
            a[: int(rng.integers(0, h)), int(rng.integers(0, w)) : int(rng.integers(0, w))] = False
        a[-1] = True
        y, x = np.nonzero(a)
        within = int(rng.integers(h, 8 * h + 1))
        want[k] = kernels.Region(y, x).is_rectangle(within), within
        rows += [(k, 7, int(i) + 3, int(j) + 5) for i, j in zip(y, x)]
    labels = spark.createDataFrame(rows, "image_id long, comp long, y long, x long")
    chosen = spark.createDataFrame([(k, 7, within) for k, (_, within) in want.items()], "image_id long, comp long, within long")
    assert 20 < sum(ok for ok, _ in want.values()) < 280
    assert {r.image_id for r in regions.rectangular(labels, chosen).collect()} == {k for k, (ok, _) in want.items() if ok}
    plain = {k: kernels.Region(*np.array([(y, x) for i, _, y, x in rows if i == k]).T).is_rectangle(60) for k in range(40)}
    got = {r.image_id: r.is_rectangle for r in regions.rectangles(labels.filter("image_id < 40"), 60).collect()}
    assert got == plain


def test_blocks(spark):
    a = np.zeros((32, 32), int)
    a[2:30, 2:30] = 255
    a[4:28, 4:28] = 0
    filled = a.copy()
    filled[7:11, 4:28] = 255
    assert kernels.is_block(a[2:29, 2:29] > 0) and not kernels.is_block(filled[2:29, 2:29] > 0)
    boxes = spark.createDataFrame([(1, 0, 2, 2, 29, 29), (2, 0, 2, 2, 29, 29), (1, 1, 0, 0, 3, 3)], "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long")
    got = {(r.image_id, r.box_id): r.is_block for r in regions.blocks(frame(spark, {1: a, 2: filled}), boxes, 32, 32).collect()}
    assert got == {(1, 0): True, (2, 0): False}


def test_nested():
    a = np.full((100, 100), 200)
    a[:, ::7] += 0
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 2, (100, 100)) * 100
    a = np.where(np.mgrid[:100, :100][1] < 101, 10 + noise, 0)
    a[5:95, 6:94] = 200
    (r, whole), *rest = kernels.nested_regions(a)
    assert r.box == (6, 5, 93, 94) and whole and not rest
    assert kernels.nested_regions(np.full((100, 100), 7)) == []  # over 90 % of the clip

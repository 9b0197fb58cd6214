"""The whole detector against a plain one, pixel by pixel and box by box."""

import numpy as np
import pytest

from gridloom.operators import kernels
from gridloom.plans import detect

from .test_boxes import by_ratios, greedy, paired
from .test_pixels import brute_labels, level_points


def plain_binary(v, least):
    h, w = v.shape
    v = v.astype(int)
    on = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            right, below = v[y, x + 1 if x + 1 < w else x - 1], v[y + 1 if y + 1 < h else y - 1, x]
            on[y, x] = (abs(right - v[y, x]) + abs(below - v[y, x])) % 256 > least
    grown = np.array([[on[y, x] or y > 0 and on[y - 1, x] for x in range(w)] for y in range(h)])
    return np.array([[grown[y, x] and (y == 0 or grown[y - 1, x]) for x in range(w)] for y in range(h)])


def without_lines(on, thickness=8):
    """Thin runs of line rows with nothing beginning behind them for thickness + 2 rows (images here end without one)."""
    out, h = on.copy(), len(on)

    def is_line(row):
        at = [x for x, v in enumerate(row) if v]
        return len(at) > 0.95 * len(row) and all(b - a <= 6 for a, b in zip(at, at[1:]))

    lines, y = [], 0
    while y < h:
        z = y
        while z < h and is_line(on[z]):
            z += 1
        if z > y:
            lines.append((y, z))
        y = z + 1
    for k, (a, b) in enumerate(lines):
        assert b < h and (k + 1 == len(lines) or lines[k + 1][0] > b + thickness + 1), "keep the pictures simple"
        if b - a < thickness:
            out[a:b] = False
    return out


class Found:
    def __init__(self, points):
        self.ys, self.xs = zip(*points)
        self.points, self.box = set(points), (min(self.xs), min(self.ys), max(self.xs), max(self.ys))
        self.width, self.height = self.box[2] - self.box[0] + 1, self.box[3] - self.box[1] + 1

    def sides(self):
        columns = {x: sorted(y for y, z in self.points if z == x) for x in set(self.xs)}
        rows = {y: sorted(x for z, x in self.points if z == y) for y in set(self.ys)}
        of = lambda lines, k: [lines[i][k] for i in sorted(lines)]
        return of(columns, 0), of(columns, -1), of(rows, 0), of(rows, -1)

    def is_line(self):
        top, bottom, left, right = self.sides()
        return any(sum(b - a <= 8 for a, b in zip(x, y)) / len(x) > 0.93 for x, y in ((top, bottom), (left, right)))

    def is_rectangle(self, image_height):
        level = [level_points(side, out, across, 0.25) for side, out, across in zip(self.sides(), (1, -1, 1, -1), (self.height, self.height, self.width, self.width))]
        return None not in level and sum(level) / (2 * (self.width + self.height)) >= (0.85 if self.height / image_height > 0.3 else 0.7)


def areas(labels, seeds):
    """Regions by the first seed that lies in them."""
    done = []
    for y, x in seeds:
        k = labels[y, x]
        if k >= 0 and k not in done:
            done.append(k)
            yield Found([(int(a), int(b)) for a, b in zip(*np.nonzero(labels == k))])


def plain_detect(image):
    v = np.array([[(299 * int(r) + 587 * int(g) + 114 * int(b) + 500) // 1000 for b, g, r in row] for row in image])
    h, w = v.shape
    on = without_lines(plain_binary(v, 10))
    seeds = [(y, x) for y in range(0, h, 5) for x in range(y % 2, w, 2)]
    kept = []
    for r in areas(brute_labels(np.zeros((h, w), int), on, 0), seeds):
        if len(r.points) < 50 or r.width <= 3 or r.height <= 3:
            continue
        long, short = max(r.width, r.height), min(r.width, r.height)
        if r.width * r.height < 50 or r.height / h > 0.8 or r.width / r.height > 50 or r.height / r.width > 40 or short < 8 and long / short > 10:
            continue
        kept.append(r.box)
    boxes, more = [], []
    for box, _ in greedy(kept, lambda a, b, _: by_ratios(a, b) == 2):
        x1, y1, x2, y2 = box
        if y2 - y1 > 50:
            clip = v[y1:y2, x1:x2]
            ch, cw = clip.shape
            inner = []
            for r in areas(brute_labels(clip, np.ones(clip.shape, bool), 5), [(y, x) for y in range(0, ch, 10) for x in range(0, cw, 10)]):
                share = r.width * r.height / (ch * cw)
                if len(r.points) >= 500 and r.height >= 30 and share <= 0.9 and not r.is_line() and r.is_rectangle(ch):
                    inner.append((tuple(a + b for a, b in zip(r.box, (x1, y1, x1, y1))), share > 0.7))
            whole = [b for b, large in inner if large]
            if whole:
                box = whole[0]
            else:
                more += [b for b, _ in inner]
        boxes.append(box)
    return [(a / w, b / h, c / w, d / h) for (a, b, c, d), _ in paired([*boxes, *more], 20)]


def picture(seed):
    rng = np.random.default_rng(seed)
    h, w = 150, 220
    a = np.full((h, w, 3), 235, np.uint8)
    for _ in range(int(rng.integers(3, 9))):
        y, x = int(rng.integers(5, h - 30)), int(rng.integers(5, w - 30))
        a[y : y + int(rng.integers(6, 70)), x : x + int(rng.integers(6, 90))] = rng.integers(0, 256, 3)
    if seed % 2:  # a panel with a panel in it, and a separating line
        a[20:130, 30:180] = (90, 120, 200)
        a[35:80, 50:110] = (20, 220, 40)
    if seed % 3 == 0:
        a[140:142] = 10
    a[:2], a[-3:] = 235, 235
    return a


@pytest.mark.parametrize("seed", range(8))
def test_detector_against_a_plain_one(seed):
    image = picture(seed)
    got, want = detect.boxes(image), plain_detect(image)
    assert np.allclose(got, want) and len(got) == len(want)


def test_nested_areas_against_plain_ones():
    rng = np.random.default_rng(9)
    found = 0
    for _ in range(6):
        a = np.kron(rng.integers(0, 3, (4, 5)), np.ones((33, 40))).astype(int) * 90
        a[rng.random(a.shape) < 0.001] = 45
        h, w = a.shape
        want = []
        for r in areas(brute_labels(a, np.ones(a.shape, bool), 5), [(y, x) for y in range(0, h, 10) for x in range(0, w, 10)]):
            share = r.width * r.height / (h * w)
            if len(r.points) >= 500 and r.height >= 30 and share <= 0.9 and not r.is_line() and r.is_rectangle(h):
                want.append((r.box, share > 0.7))
        assert [(r.box, whole) for r, whole in kernels.nested_regions(a)] == want
        found += len(want)
    assert found > 5

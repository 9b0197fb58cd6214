"""Per-image and per-component steps that are sequential by nature, on numpy arrays.

The DataFrame operators run them through Arrow batches, one image at a time;
plans.detect chains them on whole images.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np

# boxes


def relation(a, b, bias=(0, 0)) -> int:
    """functions.geometry.relation for two 4-tuples."""
    w = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 2 * bias[0])
    h = max(0, min(a[3], b[3]) - max(a[1], b[1]) + 2 * bias[1])
    common, area, other = w * h, (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    if not common:
        return 0
    if common >= area:
        return -1
    if common >= other:
        return 1
    return 2 if 50 * common >= area + other - common or 5 * common > area or 5 * common > other else 0


def hull(a, b):
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def is_close(a, b, distance: int) -> bool:
    return min(a[3], b[3]) > max(a[1], b[1]) and min(abs(a[0] - b[2]), abs(b[0] - a[2])) < distance


def relations(a, others: np.ndarray, bias=(0, 0)) -> np.ndarray:
    """relation() of one box with each row of an array of boxes."""
    w = (np.minimum(a[2], others[:, 2]) - np.maximum(a[0], others[:, 0]) + 2 * bias[0]).clip(0)
    h = (np.minimum(a[3], others[:, 3]) - np.maximum(a[1], others[:, 1]) + 2 * bias[1]).clip(0)
    common, area, other = w * h, (a[2] - a[0]) * (a[3] - a[1]), (others[:, 2] - others[:, 0]) * (others[:, 3] - others[:, 1])
    much = (50 * common >= area + other - common) | (5 * common > area) | (5 * common > other)
    return np.select([common == 0, common >= area, common >= other, much], [0, -1, 1, 2], 0)


def contained(boxes: np.ndarray, is_block: np.ndarray) -> np.ndarray:
    """Which boxes lie in another one that is no block; of two equal ones the earlier does."""
    r = np.array([relations(b, boxes) for b in boxes]).reshape(len(boxes), len(boxes))
    later = np.triu(np.ones(r.shape, bool), 1)
    holds = (r == 1) & later  # of each pair only the earlier one's view counts
    is_held = (r == -1) & later
    return (is_held & ~is_block).any(axis=1) | (holds & ~is_block[:, None]).any(axis=0)


def on_one_line(a, others: np.ndarray, gap: int) -> np.ndarray:
    """Common rows with each of others, and common columns or a horizontal gap below the limit."""
    rows = np.minimum(a[3], others[:, 3]) > np.maximum(a[1], others[:, 1])
    columns = np.minimum(a[2], others[:, 2]) - np.maximum(a[0], others[:, 0])  # negative: the gap
    return rows & (columns > 0) | rows & (columns < 0) & (columns > -gap)


def _first(hits: np.ndarray, after: int = 0) -> int | None:
    found = np.flatnonzero(hits[after:])
    return after + int(found[0]) if len(found) else None


class OrderedGrid:
    """Numbered boxes that come, grow and go; finds those that overlap a box in the order of their numbers.

    A box is in the four cells, at most, that it touches on the grid whose
    cells are the least power of two as large as it; a cell holds its numbers
    in order.
    """

    def __init__(self):
        self.levels: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.places: dict[int, tuple[int, list[tuple[int, int]]]] = {}

    @staticmethod
    def _cells(box, level: int):
        return range(box[0] >> level, (box[2] >> level) + 1), range(box[1] >> level, (box[3] >> level) + 1)

    def put(self, k: int, box) -> None:
        """Number k is this box from now on."""
        level = max(box[2] - box[0], box[3] - box[1], 1).bit_length()
        columns, rows = self._cells(box, level)
        cells = [(x, y) for x in columns for y in rows]
        if self.places.get(k) == (level, cells):
            return
        self.take(k)
        grid = self.levels.setdefault(level, {})
        for cell in cells:
            bisect.insort(grid.setdefault(cell, []), k)
        self.places[k] = level, cells

    def take(self, k: int) -> None:
        """Number k goes."""
        level, cells = self.places.pop(k, (0, ()))
        for cell in cells:
            numbers = self.levels[level][cell]
            numbers.remove(k)
            if not numbers:
                del self.levels[level][cell]

    def near(self, box, after: int = 0) -> list[int]:
        """Numbers from `after` on, in order, of the boxes in cells that this one touches."""
        found: set[int] = set()
        for level, grid in self.levels.items():
            columns, rows = self._cells(box, level)
            if len(columns) * len(rows) <= len(grid):
                cells = (grid[c] for c in itertools.product(columns, rows) if c in grid)
            else:
                cells = (numbers for (x, y), numbers in grid.items() if x in columns and y in rows)
            for numbers in cells:
                found.update(numbers[bisect.bisect_left(numbers, after) :])
        return sorted(found)


class Piles:
    """Boxes in order, each the hull of the items put on it; few are looked at one by one, of many those near on a grid."""

    FEW = 150

    def __init__(self, most: int):
        self._all, self.rows, self.members = np.zeros((most, 4), np.int64), [], []
        self.grid = OrderedGrid() if most >= self.FEW else None

    def first(self, box, test, tests, reach=(0, 0), after: int = 0) -> int | None:
        """The first pile from `after` on that passes test(box, pile), of those that overlap the box by more than -2 * reach; tests(box, piles) is the same for an array."""
        x1, y1, x2, y2 = box[0] - 2 * reach[0], box[1] - 2 * reach[1], box[2] + 2 * reach[0], box[3] + 2 * reach[1]
        near = range(after, len(self.rows))
        if len(self.rows) >= self.FEW:
            near = self.grid.near((x1, y1, x2, y2), after)
            if len(near) >= self.FEW:
                k = _first(tests(box, self._all[near]))
                return None if k is None else near[k]
        for k in near:
            other = self.rows[k]
            if x1 < other[2] and other[0] < x2 and y1 < other[3] and other[1] < y2 and test(box, other):
                return k
        return None

    def start(self, box, members) -> None:
        k = len(self.rows)
        self._all[k] = box
        self.rows.append(box)
        self.members.append(members)
        if self.grid is not None:
            self.grid.put(k, box)

    def put(self, k: int, box, members) -> tuple:
        """The pile's new hull."""
        self.rows[k] = self._all[k] = hull(self.rows[k], box)
        self.members[k] = list(dict.fromkeys([*self.members[k], *members]))
        if self.grid is not None:
            self.grid.put(k, self.rows[k])
        return self.rows[k]

    def items(self) -> list:
        return list(zip(self.rows, self.members))


def piled(items: list, place) -> list:
    """Put items on piles in order; place (piles, box, members, nth pass) puts one on others and says so, else it starts its own; again until none is put."""
    nth = 0
    while True:
        piles = Piles(len(items))
        for box, members in items:
            if not place(piles, box, members, nth):
                piles.start(box, members)
        if len(piles.members) == len(items):
            return piles.items()
        items, nth = piles.items(), nth + 1


def merge_meeting(items: list) -> list:
    """Each box joins the first kept box it meets (relation 2), until none does."""

    def place(piles, box, members, _):
        k = piles.first(box, lambda a, b: relation(a, b) == 2, lambda a, b: relations(a, b) == 2)
        if k is not None:
            piles.put(k, box, members)
        return k is not None

    return piled(items, place)


def merge_corners(items: list, with_contained: bool, gap=(0, 0)) -> list:
    """Each box joins the kept boxes, one after the other, that it holds or meets (or, if wanted, is in), growing as it does, until none does."""
    wanted = (1, 2, -1) if with_contained else (1, 2)

    def place(piles, box, members, _):
        found, after = False, 0
        while (k := piles.first(box, lambda a, b: relation(a, b, gap) in wanted, lambda a, b: np.isin(relations(a, b, gap), wanted), gap, after)) is not None:
            box = piles.put(k, box, members)
            members, after, found = piles.members[k], k + 1, True
        return found

    return piled(items, place)


def merge_text(items: list, gap: int = 4, height: int = 20) -> list:
    """Low boxes join the first kept box on their line; in later passes with the default limits."""

    def place(piles, box, members, nth):
        limit, low = (gap, height) if nth == 0 else (4, 20)
        one = lambda a, b: bool(on_one_line(a, np.array([b]), limit)[0])
        k = piles.first(box, one, lambda a, b: on_one_line(a, b, limit), (limit, 0)) if box[3] - box[1] <= low else None
        if k is not None:
            piles.put(k, box, members)
        return k is not None

    return piled(items, place)


def _first_close(items: list, near, free: np.ndarray, i: int, distance: int) -> int | None:
    """The first free box behind the i-th that is close to it, out of the numbers `near`."""
    x1, y1, x2, y2 = items[i][0]
    for k in near:
        o = items[k][0]
        if y1 < o[3] and o[1] < y2 and (-distance < x1 - o[2] < distance or -distance < o[0] - x2 < distance) and free[k]:
            return k
    return None


def merge_close(items: list, distance: int = 20) -> list:
    """In rounds: in order, each box that is still free is paired with the first free close box behind it; pairs become their hulls, until there is none.

    A hull is compared in the next round only, so a round is a matching on the
    graph of close pairs among the boxes as the round finds them; of many boxes
    a grid holds those that are free.
    """
    while True:
        free = np.ones(len(items), bool)
        grid = OrderedGrid() if len(items) >= Piles.FEW else None
        if grid is not None:
            for i, (box, _) in enumerate(items):
                grid.put(i, box)
        out = []
        for i, (box, members) in enumerate(items):
            if not free[i]:
                continue
            near = range(i + 1, len(items)) if grid is None else grid.near((box[0] - distance, box[1], box[2] + distance, box[3]), i + 1)
            k = _first_close(items, near, free, i, distance)
            if k is not None:
                free[k] = False
                if grid is not None:
                    grid.take(k)
                other, others = items[k]
                box, members = hull(box, other), [*members, *others]
            out.append((box, members))
        if len(out) == len(items):
            return out
        items = out


# pixels


def gradient(v: np.ndarray, saturate: bool = False) -> np.ndarray:
    """|right - v| + |below - v|, the last column and row against the one before; wrapped at 256, or kept at 255."""
    v = v.astype(np.int64)
    across, down = np.zeros_like(v), np.zeros_like(v)
    if v.shape[1] > 1:
        across[:, :-1] = np.abs(v[:, 1:] - v[:, :-1])
        across[:, -1] = across[:, -2]
    if v.shape[0] > 1:
        down[:-1] = np.abs(v[1:] - v[:-1])
        down[-1] = down[-2]
    g = across + down
    return np.minimum(g, 255) if saturate else g % 256


def close_gaps(on: np.ndarray, kernel: tuple[int, int] = (2, 1)) -> np.ndarray:
    """Dilate, then erode, with a rows x columns kernel anchored at half its size."""

    def slide(a, most, outside):
        for axis, size in enumerate(kernel):
            anchor = size // 2
            padded = np.pad(a, [(anchor, size - 1 - anchor) if k == axis else (0, 0) for k in (0, 1)], constant_values=outside)
            views = [np.take(padded, range(k, k + a.shape[axis]), axis=axis) for k in range(size)]
            a = most(np.stack(views), axis=0)
        return a

    return slide(slide(on.astype(bool), np.any, False), np.all, True)


def median(image: np.ndarray, size: int) -> np.ndarray:
    """The median of the size x size square around each pixel, channel by channel, the border repeated outwards; size is odd."""
    reach = size // 2
    padded = np.pad(image, [(reach, reach), (reach, reach), *[(0, 0)] * (image.ndim - 2)], mode="edge")
    if image.ndim == 2:
        return inner_median(padded, size)
    return np.stack([inner_median(padded[:, :, k], size) for k in range(image.shape[2])], axis=2)


def inner_median(padded: np.ndarray, size: int) -> np.ndarray:
    """The median of each size x size square that lies in the array.

    Small squares, and those of arrays with very many levels, are partitioned.
    For others a histogram of each column slides down the rows; sums of neighbouring columns, in 16 coarse classes and
    then in the fine ones of the median's class, take the same time for any size.
    """
    half, rows, columns = size * size // 2, padded.shape[0] - size + 1, padded.shape[1] - size + 1
    out = np.empty((rows, columns), padded.dtype)
    values, ranks = np.unique(padded, return_inverse=True) if size > 5 else (None, None)
    if size <= 5 or len(values) > 1024:
        step = max(1, 4_000_000 // (size * size * columns))
        for at in range(0, rows, step):  # some rows at a time
            view = np.lib.stride_tricks.sliding_window_view(padded[at : at + step + size - 1], (size, size))
            out[at : at + step] = np.partition(view.reshape(*view.shape[:2], -1), half, axis=-1)[..., half]
        return out
    ranks = ranks.reshape(padded.shape)
    fine = -(-len(values) // 16)  # levels of a coarse class
    coarse_of, fine_of, each = ranks // fine, ranks % fine, np.arange(padded.shape[1])
    held = np.zeros((padded.shape[1], 16, fine), np.int32)
    for row in range(size - 1):
        held[each, coarse_of[row], fine_of[row]] += 1
    for row in range(rows):
        held[each, coarse_of[row + size - 1], fine_of[row + size - 1]] += 1
        sums = np.zeros((padded.shape[1] + 1, 16, fine), np.int32)
        np.cumsum(held, axis=0, out=sums[1:])
        classes = sums.sum(axis=2)
        below = np.cumsum(classes[size:] - classes[:-size], axis=1)
        chosen = (below <= half).sum(axis=1)
        at = np.arange(columns)
        before = np.where(chosen > 0, below[at, chosen - 1], 0)
        levels = np.cumsum(sums[at + size, chosen] - sums[at, chosen], axis=1) + before[:, None]
        out[row] = values[chosen * fine + (levels <= half).sum(axis=1)]
        held[each, coarse_of[row], fine_of[row]] -= 1
    return out


#: Shares of two neighbours sum up to this.
WHOLE = 2048


def between(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new place along an axis: the old place at or before its centre, and that one's share of WHOLE."""
    at = (np.arange(new) + 0.5) * (old / new) - 0.5
    lower = np.floor(at).astype(np.int64)
    beyond = at - lower
    beyond[(lower < 0) | (lower >= old - 1)] = 0
    return lower.clip(0, old - 1), np.rint((1 - beyond) * WHOLE).astype(np.int64)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Between the four pixels around each new one's centre, in fixed point: shares of 2048, four bits dropped between the axes."""
    (left, a), (above, b) = between(image.shape[1], width), between(image.shape[0], height)
    v = image.astype(np.int64)
    more = [1] * (image.ndim - 2)
    a, b = a.reshape(1, -1, *more), b.reshape(-1, 1, *more)
    rows = v[:, left] * a + v[:, (left + 1).clip(0, image.shape[1] - 1)] * (WHOLE - a)
    below = (above + 1).clip(0, image.shape[0] - 1)
    out = ((b * (rows[above] >> 4)) >> 16) + (((WHOLE - b) * (rows[below] >> 4)) >> 16)
    return ((out + 2) >> 2).astype(image.dtype)


def is_line_row(row: np.ndarray, gap: int = 5, share: float = 0.95) -> bool:
    """Set pixels on more than the share of the width, without an inner gap over the limit."""
    at = np.flatnonzero(row)
    return len(at) > share * len(row) and (np.diff(at) <= gap + 1).all()


def line_erasures(valid: list[bool], thickness: int = 8) -> list[tuple[int, int]]:
    """Row ranges [a, b) that hold thin horizontal lines, told by runs of line rows and the room behind them.

    A thin run (less than `thickness` rows) goes if no other run begins in the
    thickness + 2 rows behind it; if one does, the thin run is spared.  If that
    one reaches over the end of the room, it counts only from the row after
    the room on.  A thin run that the image's end cuts off goes but for the last
    row, unless a spared one's room takes it in.
    """
    steps = np.flatnonzero(np.diff(np.concatenate([[False], np.asarray(valid, bool), [False]]).astype(np.int8)))
    out: list[tuple[int, int]] = []
    n, from_row = len(valid), 0
    starts, stops = steps[::2].tolist(), steps[1::2].tolist()
    for a, b, c, d in zip(starts, stops, [*starts[1:], math.inf], [*stops[1:], math.inf]):
        a = max(a, from_row)
        if not a < b < a + thickness:
            continue  # taken in, or thick
        room = b + thickness + 1
        if b == n:
            out.append((a, n - 1))
        elif c > room:
            out.append((a, b))
        elif d > room or d == n:
            from_row = min(room + 1, n)
    return [(a, b) for a, b in out if a < b]


def erase_lines(on: np.ndarray, thickness: int = 8) -> np.ndarray:
    out = on.copy()
    for a, b in line_erasures([is_line_row(r) for r in on], thickness):
        out[a:b] = False
    return out


# regions


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def label(values: np.ndarray, on: np.ndarray, tolerance: int = 0) -> np.ndarray:
    """4-connected regions of `on` pixels whose neighbours differ by the tolerance at most; the label is the region's least pixel index, -1 off."""
    h, w = values.shape
    v = values.astype(np.int64)
    index = np.arange(h * w).reshape(h, w)
    right = on[:, 1:] & on[:, :-1] & (np.abs(v[:, 1:] - v[:, :-1]) <= tolerance)
    below = on[1:] & on[:-1] & (np.abs(v[1:] - v[:-1]) <= tolerance)
    a = np.concatenate([index[:, :-1][right], index[:-1][below]])
    b = np.concatenate([index[:, 1:][right], index[1:][below]])
    parent = np.arange(h * w)
    while len(a):  # hook the greater root below the lesser, then flatten
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)
    return np.where(on, parent.reshape(h, w), -1)


class Region:
    """A region's pixels: borders as (low, high) per column and per row, inclusive box and sizes."""

    def __init__(self, ys: np.ndarray, xs: np.ndarray):
        self.n = len(ys)
        self.x1, self.x2, self.y1, self.y2 = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
        self.width, self.height = self.x2 - self.x1 + 1, self.y2 - self.y1 + 1
        self.top, self.bottom = np.full(self.width, 1 << 30), np.full(self.width, -1)
        self.left, self.right = np.full(self.height, 1 << 30), np.full(self.height, -1)
        np.minimum.at(self.top, xs - self.x1, ys)
        np.maximum.at(self.bottom, xs - self.x1, ys)
        np.minimum.at(self.left, ys - self.y1, xs)
        np.maximum.at(self.right, ys - self.y1, xs)

    @property
    def box(self):
        return self.x1, self.y1, self.x2, self.y2

    def is_line(self, thickness: int = 8) -> bool:
        return any(((hi - lo) <= thickness).mean() > 0.93 for lo, hi in ((self.top, self.bottom), (self.left, self.right)))

    def is_rectangle(self, clip_height: int, evenness: float = 0.7, dent: float = 0.25) -> bool:
        """Four borders that are mostly flat, without long steps or wide dents."""
        sides = ((self.top, 1, self.height), (self.bottom, -1, self.height), (self.left, 1, self.width), (self.right, -1, self.width))
        flat = [flat_points(border, outwards, across, dent) for border, outwards, across in sides]
        if None in flat:
            return False
        return sum(flat) / (2 * (self.width + self.height)) >= (0.85 if self.height / clip_height > 0.3 else evenness)


def flat_points(border: np.ndarray, outwards: int, across: int, dent: float) -> int | None:
    """How many points of a border are level with where it begins; None if it can't be a rectangle's.

    Depths are differences to a point of reference: the first one behind the
    corner, or the one behind the last great outward step within the first 8 %.
    More than a tenth of the border in a row far off, or a share over `dent`
    sunken, is no rectangle's.
    """
    n = len(border)
    at = np.arange(int(3 + n * 0.02), n - 1)
    if not len(at):
        return 0
    steps = outwards * (border[at] - border[at + 1]) / across
    reference = np.maximum.accumulate(np.where((at / n < 0.08) & (steps > 0.5), at + 1, at[0]))
    depth = border[reference] - border[at + 1]
    off = np.abs(depth) / across
    far = off > 0.3
    edges = np.flatnonzero(np.diff(np.concatenate([[False], far, [False]]).astype(np.int8)))
    sunken = ~far & (off > 0.15) & (outwards * depth < 0)
    if (edges[1::2] - edges[::2]).max(initial=0) / n > 0.1 or sunken.sum() / n > dent:
        return None
    return int((~far & ~sunken & (np.abs(depth) < 1 + across * 0.015)).sum())


def regions(labels: np.ndarray) -> dict[int, Region]:
    """label -> Region, in order of the labels."""
    ys, xs = np.nonzero(labels >= 0)
    of = labels[ys, xs]
    order = np.argsort(of, kind="stable")
    names, first = np.unique(of[order], return_index=True)
    return {int(k): Region(ys[o], xs[o]) for k, o in zip(names, np.split(order, first[1:]))} if len(of) else {}


def pieces(values: np.ndarray, on: np.ndarray, at: tuple[int, int], origin: tuple[int, int], tile: int, tolerance: int, steps: tuple[int, int], least: int, borders: bool) -> dict[str, list | np.ndarray]:
    """The regions of a tile's pixels as columns, an entry per region, positions less the origin (y, x); at: position of the first pixel.

    Regions of fewer than `least` pixels are left out, unless they may go on in
    another tile.  comp: y << 20 | x of the first pixel; seed: of the first
    lattice point, or -1; edge: the pixels (axis, at, along, v) that meet
    another tile, `at` being the first line behind the border, and whether
    they lie before it; arrays with their lengths are flat.
    """
    root = label(values, on, tolerance)
    ys, xs = np.nonzero(on)
    lab, v = root[ys, xs], values[ys, xs].astype(np.int64)
    ys, xs = ys + at[0], xs + at[1]
    # positions count from 0, so nothing lies before the first line
    touching = np.zeros(len(ys), bool)
    for across in (ys, xs):
        touching |= (across % tile == tile - 1) | ((across % tile == 0) & (across > 0))
    counts = np.bincount(lab, minlength=root.size) if len(lab) else np.zeros(root.size, np.int64)
    keep = counts >= least
    keep[lab[touching]] = True
    kept = keep[lab]
    ys, xs, v, lab = ys[kept], xs[kept], v[kept], lab[kept]
    names, inv = np.unique(lab, return_inverse=True)
    order = np.argsort(inv, kind="stable")
    starts = np.searchsorted(inv[order], np.arange(len(names)))
    y, x = ys[order] - origin[0], xs[order] - origin[1]
    low = lambda a: np.minimum.reduceat(a, starts) if len(names) else a
    high = lambda a: np.maximum.reduceat(a, starts) if len(names) else a
    seeds = np.where(on_lattice(y, x, *steps), y << 20 | x, 1 << 62)
    seed = low(seeds)
    found = {"comp": low(y << 20 | x), "n_pixels": counts[names], "x1": low(x), "y1": low(y), "x2": high(x), "y2": high(y), "seed": np.where(seed == 1 << 62, -1, seed)}
    edges = []
    for axis, across, along in ((0, ys, xs), (1, xs, ys)):
        for before, hit in ((True, across % tile == tile - 1), (False, (across % tile == 0) & (across > 0))):
            k = np.flatnonzero(hit)
            edges.append((inv[k], np.full(len(k), axis), across[k] + before, along[k], v[k], np.full(len(k), before)))
    edges = [np.concatenate(c) for c in zip(*edges)]
    by = np.argsort(edges[0], kind="stable")
    found["edge"] = np.bincount(edges[0], minlength=len(names)), [e[by] for e in edges[1:]]
    if borders:
        for first, last, line, across in (("top", "bottom", x, y), ("left", "right", y, x)):
            of = inv[order]
            by = np.lexsort((across, line, of))
            of, ln, ac = of[by], line[by], across[by]
            begin = np.ones(len(of), bool)
            begin[1:] = (of[1:] != of[:-1]) | (ln[1:] != ln[:-1])
            end = np.append(begin[1:], True) if len(of) else begin
            sizes = np.bincount(of[begin], minlength=len(names))
            found[first], found[last] = (sizes, ac[begin]), (sizes, ac[end])
    return found


def on_lattice(y: np.ndarray, x: np.ndarray, step_y: int = 5, step_x: int = 2) -> np.ndarray:
    """Seed points: every step_y-th row, every step_x-th column from row mod 2 on."""
    return (y % step_y == 0) & ((x - y % 2) % step_x == 0) & (x >= y % 2)


def detect_regions(on: np.ndarray, min_area: int, step_y: int = 5, step_x: int = 2) -> list[Region]:
    """Regions that hold a seed, in order of their first seed, large enough and over 3 pixels wide and high."""
    labels = label(np.zeros(on.shape, int), on)
    ys, xs = np.nonzero(on)
    seeds = on_lattice(ys, xs, step_y, step_x)
    names, first = np.unique(labels[ys[seeds], xs[seeds]], return_index=True)
    found = regions(labels)
    ordered = (found[int(k)] for k in names[np.argsort(first)])
    return [r for r in ordered if r.n >= min_area and r.width > 3 and r.height > 3]


def is_block(clip: np.ndarray, share: float = 0.15) -> bool:
    """Are the fifth to eighth lines from each side nearly blank (two of four may be not)?  Smaller clips are no blocks."""
    if min(clip.shape) < 9:
        return False
    rows, cols = clip.sum(axis=1) > share * clip.shape[1], clip.sum(axis=0) > share * clip.shape[0]
    return all(lines[part].sum() <= 2 for lines in (rows, cols) for part in (slice(5, 9), slice(len(lines) - 8, len(lines) - 4)))


def nested_regions(gray: np.ndarray, tolerance: int = 5, least: int = 500, least_height: int = 30) -> list[tuple[Region, bool]]:
    """Rectangular even areas of a clip by seed order, and whether they fill so much of it that they replace it."""
    h, w = gray.shape
    labels = label(gray, np.ones(gray.shape, bool), tolerance)
    seeds = labels[::10, ::10].ravel()
    names, first = np.unique(seeds, return_index=True)
    found = regions(np.where(np.isin(labels, names), labels, -1))
    out = []
    for k in names[np.argsort(first)].tolist():
        r = found[k]
        share = r.width * r.height / (h * w)
        if r.n >= least and r.height >= least_height and share <= 0.9 and not r.is_line() and r.is_rectangle(h):
            out.append((r, share > 0.7))
    return out


# model


def erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def rms_norm(x: np.ndarray, weight: np.ndarray | None = None, eps: float = 1e-6) -> np.ndarray:
    out = x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps)
    return out if weight is None else out * weight


def linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    out = x @ weight.T
    return out if bias is None else out + bias


def rotate(x: np.ndarray, angles: np.ndarray) -> np.ndarray:
    half = x.shape[-1] // 2
    return x * np.cos(angles) + np.concatenate([-x[..., half:], x[..., :half]], axis=-1) * np.sin(angles)


def formula_weights(out: int, inner: int, layer: int) -> np.ndarray:
    """The fixtures' weights; other models pass their own matrices of the same shapes."""
    o, i = np.arange(out)[:, None], np.arange(inner)
    return ((o * 31 + i * 17 + layer * 7) % 13 - 6) / 64.0


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, allowed: np.ndarray | None = None, added: np.ndarray | None = None) -> np.ndarray:
    """Scaled dot-product attention over (..., heads, positions, dim); k and v may have fewer heads, each for a group of q's."""
    group = q.shape[-3] // k.shape[-3]
    k, v = (np.repeat(x, group, axis=-3) if group > 1 else x for x in (k, v))
    scores = q @ np.swapaxes(k, -1, -2) / math.sqrt(q.shape[-1])
    if added is not None:
        scores = scores + added
    if allowed is not None:
        scores = np.where(allowed, scores, -np.inf)
    return softmax(scores) @ v


def attention_in_blocks(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask_mode: str = "causal", block: int = 512) -> np.ndarray:
    """attention() of one sequence under a mask mode (causal, none, additive), by blocks of queries and keys with a running maximum and sum."""
    n, group = q.shape[1], q.shape[0] // k.shape[0]
    out = np.empty((*q.shape[:2], v.shape[-1]))
    for a in range(0, n, block):
        b = min(a + block, n)
        top, total, mixed = np.full((q.shape[0], b - a, 1), -np.inf), 0.0, 0.0
        for c in range(0, b if mask_mode == "causal" else n, block):
            keys, values = (np.repeat(x[:, c : c + block], group, axis=0) for x in (k, v))
            scores = q[:, a:b] @ keys.transpose(0, 2, 1) / math.sqrt(q.shape[-1])
            below = np.arange(c, c + keys.shape[1]) <= np.arange(a, b)[:, None]
            if mask_mode == "additive":
                scores = scores + below
            elif mask_mode == "causal" and c == a:  # the blocks before are all below
                scores = np.where(below, scores, -np.inf)
            higher = np.maximum(top, scores.max(axis=-1, keepdims=True))
            kept, shares = np.exp(top - higher), np.exp(scores - higher)
            total, mixed, top = total * kept + shares.sum(axis=-1, keepdims=True), mixed * kept + shares @ values, higher
        out[:, a:b] = mixed / total
    return out


def attention_part(q: np.ndarray, k: np.ndarray, v: np.ndarray, q_pos: np.ndarray, k_pos: np.ndarray, mask_mode: str = "causal", block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What some keys give some queries (heads, positions, numbers): the greatest score, the sum of exp(score - greatest) and the values so weighted.

    A query that sees none of the keys has -inf, 0 and 0.
    """
    group = q.shape[0] // k.shape[0]
    found = None
    for c in range(0, k.shape[1], block):
        keys, values = (np.repeat(x[:, c : c + block], group, axis=0) for x in (k, v))
        scores = q @ keys.transpose(0, 2, 1) / math.sqrt(q.shape[-1])
        below = k_pos[c : c + block] <= q_pos[:, None]
        if mask_mode == "additive":
            scores = scores + below
        elif mask_mode == "causal":
            scores = np.where(below, scores, -np.inf)
        top = scores.max(axis=-1, keepdims=True)
        shares = np.exp(scores - np.where(np.isfinite(top), top, 0.0))
        part = [top, shares.sum(axis=-1, keepdims=True), shares @ values]
        found = part if found is None else merge_parts(found, part)
    return tuple(found)


def merge_parts(a, b):
    """Two results of attention_part for the same queries as one."""
    top = np.maximum(a[0], b[0])
    safe = np.where(np.isfinite(top), top, 0.0)
    x, y = np.exp(a[0] - safe), np.exp(b[0] - safe)
    return [top, a[1] * x + b[1] * y, a[2] * x + b[2] * y]

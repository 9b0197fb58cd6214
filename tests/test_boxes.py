import itertools
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridloom.operators import boxes, kernels, merging

box = st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 30), st.integers(1, 30)).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))


def by_ratios(a, b, bias=(0, 0)):
    """The relation as ratios of areas say it."""
    w = max(0, min(a[2], b[2]) + bias[0] - max(a[0] - bias[0], b[0] - bias[0]))
    h = max(0, min(a[3], b[3]) + bias[1] - max(a[1] - bias[1], b[1] - bias[1]))
    common, p, q = w * h, (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    if not common:
        return 0
    if common / p >= 1:
        return -1
    if common / q >= 1:
        return 1
    return 2 if common / (p + q - common) >= 0.02 or common / p > 0.2 or common / q > 0.2 else 0


@given(box, box)
def test_relation(a, b):
    r = kernels.relation(a, b)
    assert r == by_ratios(a, b) and kernels.relation(a, b, (2, 1)) == by_ratios(a, b, (2, 1))
    if a == b:
        assert r == kernels.relation(b, a) == -1
    else:
        assert (r == -1) == (kernels.relation(b, a) == 1) or {r, kernels.relation(b, a)} <= {-1, 1}


@given(st.lists(box, max_size=12))
def test_merges_are_stable_and_cover(found):
    items = [(b, [k]) for k, b in enumerate(found)]
    for merge in (kernels.merge_meeting, kernels.merge_close, kernels.merge_text, lambda x: kernels.merge_corners(x, True)):
        out = merge(list(items))
        assert sorted({m for _, ms in out for m in ms}) == list(range(len(found)))
        for b, members in out:
            for m in members:
                assert b[0] <= found[m][0] and b[1] <= found[m][1] and b[2] >= found[m][2] and b[3] >= found[m][3]
        assert [b for b, _ in merge(out)] == [b for b, _ in out]
    assert all(kernels.relation(a, b) != 2 for (a, _), (b, _) in itertools.combinations(kernels.merge_meeting(items), 2)) or len(found) < 2


def test_merges_are_not_transitive():
    chain = [((0, 0, 10, 10), [0]), ((15, 0, 25, 10), [1]), ((30, 0, 40, 10), [2]), ((200, 0, 210, 10), [3])]
    assert [b for b, _ in kernels.merge_close(chain, 8)] == [(0, 0, 40, 10), (200, 0, 210, 10)]
    wide = [((0, 0, 100, 10), [0]), ((40, 2, 60, 8), [1])]
    assert kernels.merge_close(wide, 20) == wide  # deep inside is not close


FIELDS = "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long"


def some_boxes(n=60, images=3, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(images):
        for k in range(n):
            x, y = rng.randint(0, 200), rng.randint(0, 150)
            out.append((i, k, x, y, x + rng.randint(1, 150), y + rng.randint(1, 90)))
    out += [(9, 0, 0, 0, 5, 5), (9, 1, 0, 0, 5, 5), (8, 0, 1, 1, 2, 2)]
    return out


def test_pairs_over_cells_are_all_pairs_once(spark):
    rows = some_boxes()
    df = spark.createDataFrame(rows, FIELDS)
    for bias in ((0, 0), (5, 3)):
        got = sorted((r.image_id, r.a_box_id, r.b_box_id, r.relation) for r in boxes.related_pairs(df, bias).collect())
        want = sorted((a[0], a[1], b[1], r) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and (r := kernels.relation(a[2:], b[2:], bias)))
        assert got == want
    close = sorted((r.image_id, r.a_box_id, r.b_box_id) for r in boxes.close_pairs(df, 20).collect())
    assert close == sorted((a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and kernels.is_close(a[2:], b[2:], 20))
    counts = {(r.image_id, r.relation): r.n_pairs for r in boxes.relation_counts(df).collect()}
    assert sum(n for (i, _), n in counts.items() if i == 0) == 60 * 59 // 2 and counts[9, -1] == 1
    assert {r.box_id for r in boxes.drop_contained(df.selectExpr("*", "'Compo' AS category")).filter("image_id = 9").collect()} == {1}


def greedy(found, fits, several=False):
    """Merges by the words of the rule: in order, each box goes to the first kept one that fits (or to each, growing), until all stay."""
    groups = [(b, {k}) for k, b in enumerate(found)]
    passes = 0
    while True:
        kept = []
        for b, ids in groups:
            home = False
            for g in kept:
                if fits(b, g[0], passes):
                    g[0] = tuple(f(x, y) for f, x, y in zip((min, min, max, max), b, g[0]))
                    g[1] |= ids
                    b, ids, home = g[0], set(g[1]), True
                    if not several:
                        break
            if not home:
                kept.append([b, set(ids)])
        passes += 1
        if len(kept) == len(groups):
            return [(tuple(b), sorted(ids)) for b, ids in kept]
        groups = [(tuple(b), ids) for b, ids in kept]


def on_a_line(a, b, gap):
    if not set(range(a[1], a[3])) & set(range(b[1], b[3])):
        return False
    left, right = sorted([a, b])
    return right[0] < max(left[2], 0) if right[0] < left[2] else 0 < right[0] - left[2] < gap


FEW = st.sampled_from([0, 3, 150])  # from how many boxes on they are looked at together


@given(st.lists(box, max_size=14), FEW)
def test_merges_against_brute_force(found, few):
    kernels.Piles.FEW = few
    items = [(b, [k]) for k, b in enumerate(found)]
    plain = lambda merged: [(b, sorted(m)) for b, m in merged]
    assert plain(kernels.merge_meeting(items)) == greedy(found, lambda a, b, _: by_ratios(a, b) == 2)
    for wanted in ({1, 2}, {1, 2, -1}):
        assert plain(kernels.merge_corners(items, -1 in wanted, (2, 1))) == greedy(found, lambda a, b, _: by_ratios(a, b, (2, 1)) in wanted, several=True)
    low = lambda a, b, n: a[3] - a[1] <= (20 if n else 12) and on_a_line(a, b, 4 if n else 9)
    assert plain(kernels.merge_text(items, 9, 12)) == greedy(found, low)


def paired(found, distance):
    """merge_close with sets of ids: rounds of pairs among the boxes of the round."""
    groups = [(b, {k}) for k, b in enumerate(found)]
    while True:
        left, out = list(range(len(groups))), []
        while left:
            i, left = left[0], left[1:]
            a = groups[i][0]
            partner = [j for j in left if set(range(a[1], a[3])) & set(range(groups[j][0][1], groups[j][0][3])) and (abs(a[0] - groups[j][0][2]) < distance or abs(groups[j][0][0] - a[2]) < distance)][:1]
            left = [j for j in left if j not in partner]
            members = [groups[k] for k in [i, *partner]]
            corners = list(zip(*(b for b, _ in members)))
            out.append(((min(corners[0]), min(corners[1]), max(corners[2]), max(corners[3])), set().union(*(m for _, m in members))))
        if len(out) == len(groups):
            return [(b, sorted(m)) for b, m in out]
        groups = out


@given(st.lists(box, max_size=14), st.integers(1, 25), FEW)
def test_close_merges_against_brute_force(found, distance, few):
    kernels.Piles.FEW = few
    got = kernels.merge_close([(b, [k]) for k, b in enumerate(found)], distance)
    assert [(tuple(b), sorted(m)) for b, m in got] == paired(found, distance)


@pytest.fixture(autouse=True)
def as_usual():
    yield
    kernels.Piles.FEW = 150


@given(st.lists(st.tuples(box, st.booleans()), max_size=10))
def test_contained_against_brute_force(found):
    at, is_block = np.array([b for b, _ in found], dtype=np.int64).reshape(-1, 4), np.array([k for _, k in found], dtype=bool)
    inside = lambda a, b: a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]
    want = [any(i != j and not other_is_block and inside(a, b) and (a != b or i < j) for j, (b, other_is_block) in enumerate(found)) for i, (a, _) in enumerate(found)]
    assert kernels.contained(at, is_block).tolist() == want


def test_merging_by_image(spark):
    rows = some_boxes(20)
    df = spark.createDataFrame(rows, FIELDS)
    got = {(r.image_id, r.box_id): (r.x1, r.y1, r.x2, r.y2) for r in merging.merge_meeting(df).collect()}
    for i in range(3):
        own = [r for r in rows if r[0] == i]
        out = greedy([r[2:] for r in own], lambda a, b, _: by_ratios(a, b) == 2)
        assert {k: b for k, b in got.items() if k[0] == i} == {(i, own[m[0]][1]): b for b, m in out}
    assert merging.merge_meeting(df.limit(0)).count() == 0


def test_numbers_in_large_groups(spark):
    from gridloom.operators.ranks import numbered

    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randrange(40), k) for k in range(3000)] + [(9, None, 5000), (9, None, 5001), (9, 0, 4999)]
    df = spark.createDataFrame(rows, "image_id long, y1 long, box_id long").repartition(5)
    order = lambda v: (v is not None, v or 0)
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: (order(r[0]), order(r[1]), r[2])):
        want[r] = last[r[0]] = last.get(r[0], 0) + 1
    for spread_from, ranges in ((10**6, None), (100, 7), (100, 40), (0, 1), (0, None)):
        got = numbered(df, ["image_id"], ["y1", "box_id"], "nth", spread_from, ranges)
        assert got.columns == ["image_id", "y1", "box_id", "nth"]
        assert {tuple(r)[:3]: r.nth for r in got.collect()} == want
    assert numbered(df.limit(0), ["image_id"], ["box_id"], "nth", 0).count() == 0

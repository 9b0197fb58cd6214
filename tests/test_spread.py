"""Work that is spread over tasks against the same done whole."""

import numpy as np
import pytest

from gridloom.operators import kernels, models, tiled, vectors
from gridloom.sources import weights


class Seeded:
    """All parameters that a model may have, by name."""

    def __call__(self, name, *shape):
        rng = np.random.default_rng(sum(map(ord, name)))
        return rng.standard_normal(shape) / np.sqrt(shape[-1]) + ("norm" in name)


CONFIG = models.FuserConfig(dim=24, heads=6, kv_heads=2, mlp=40, layers=2, parameters=Seeded())


def triples(spark, n=23, slots=3, dim=24):
    rng = np.random.default_rng(4)
    rows = [(i // 4, i % 4, s, rng.standard_normal(dim).tolist()) for i in range(n) for s in range(slots + (i == 7))]
    return spark.createDataFrame(rows, "image_id long, box_idx long, slot int, vec array<double>").repartition(5)


def by_key(rows):
    return {(r.image_id, r.box_idx): np.array(r.vec) for r in rows.collect()}


@pytest.mark.parametrize("tile, group_rows, mask_mode", [(7, 12, "causal"), (16, 1000, "additive"), (100, 30, "causal")])
def test_tiled_decoder(spark, tile, group_rows, mask_mode):
    """Sequences of two lengths, tiles that meet neither heads nor widths or hold whole matrices, several groups or one."""
    config = models.FuserConfig(**{**CONFIG.__dict__, "mask_mode": mask_mode, "layers": 1 if tile > 7 else 2})
    rows = triples(spark)
    want, got = by_key(models.fuse_triples(rows, config)), by_key(tiled.fuse_triples(rows, config, tile=tile, group_rows=group_rows))
    assert want.keys() == got.keys() and len(want) == 23
    for k, vec in want.items():
        np.testing.assert_allclose(got[k], vec, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("together", (1, 8 * 7 * 12 * 3, 8 * 7 * 30 * 4))
def test_tiled_decoder_in_parts(spark, monkeypatch, together):
    """Tasks that take one tile of columns, some, or some of columns and of output."""
    rows = triples(spark)
    config = models.FuserConfig(**{**CONFIG.__dict__, "layers": 1})
    monkeypatch.setattr(tiled, "TOGETHER", together)
    want, got = by_key(models.fuse_triples(rows, config)), by_key(tiled.fuse_triples(rows, config, tile=7, group_rows=12))
    assert want.keys() == got.keys()
    for k, vec in want.items():
        np.testing.assert_allclose(got[k], vec, rtol=1e-9, atol=1e-9)


def test_a_product_moves_activations_once(spark):
    x = spark.createDataFrame([(g, t, 2, bytearray(np.full((2, 5), t + 1.0).tobytes())) for g in range(2) for t in range(3)], "grp long, tile int, n int, data binary")
    w = spark.createDataFrame([("w", o, k, bytearray(np.full((5, 5), o + 1.0).tobytes())) for o in range(2) for k in range(3)], "name string, o int, k int, data binary")
    y = tiled.multiply(x, w, ["w"], tiled.plain(["w"], {}), 5, (10, 15), (3, 2), residual=x.filter("tile < 2"))
    assert {(r.grp, r.tile, tuple(np.frombuffer(r.data))) for r in y.collect()} == {(g, o, (30.0 * (o + 1) + o + 1,) * 10) for g in range(2) for o in range(2)}
    assert str(y._jdf.queryExecution().executedPlan()).split("== Initial Plan ==")[0].count("+- Exchange ") == 1


def test_tiles_of_a_stored_model(spark, tmp_path):
    config = models.FuserConfig(**{**CONFIG.__dict__, "layers": 1})
    shapes = tiled.shapes_of(config)
    weights.write({f"{n}.weight": Seeded()(f"{n}.weight", *s) for n, s in shapes.items()} | {"norm.weight": np.ones(24)}, spark, str(tmp_path / "model"))
    made = {(r.name, r.o, r.k): bytes(r.data) for r in tiled.tiles_of(weights.read(spark, str(tmp_path / "model")), 10).collect()}
    assert made == {(r.name, r.o, r.k): bytes(r.data) for r in tiled.tiles_by_rule(spark, shapes, Seeded(), 10).collect()}
    assert max(map(len, made.values())) == 10 * 10 * 8 and len({n for n, _, _ in made}) == len(shapes)
    assert tiled.fuse_triples(triples(spark, 0), config).count() == 0


@pytest.mark.parametrize("mask_mode", ["causal", "none", "additive"])
@pytest.mark.parametrize("kv", [None, 1])
def test_spread_attention(spark, mask_mode, kv):
    rng = np.random.default_rng(1)
    sizes = {0: 3, 1: 50, 2: 131, 3: 1}
    rows = [(seq, pos, rng.standard_normal(12).tolist()) for seq, n in sizes.items() for pos in range(n)]
    frame = spark.createDataFrame(rows, "seq long, pos long, vec array<double>").repartition(3)
    key = lambda r: (r.seq, r.pos, r.head)
    want = sorted(vectors.attention(frame, 3, kv, mask_mode).collect(), key=key)
    for query_block, key_chunk in ((16, 40), (10, 7), (500, 500)):
        got = sorted(vectors.attention(frame, 3, kv, mask_mode, spread_from=10, query_block=query_block, key_chunk=key_chunk).collect(), key=key)
        assert list(map(key, got)) == list(map(key, want))
        np.testing.assert_allclose([r.out for r in got], [r.out for r in want], rtol=1e-9, atol=1e-12)


def test_parts_merge_in_any_order():
    rng = np.random.default_rng(3)
    q, k, v = (rng.standard_normal((2, n, 4)) * 30 for n in (5, 9, 9))
    cuts = [slice(0, 2), slice(2, 3), slice(3, 9)]
    part = lambda s: kernels.attention_part(q, k[:, s], v[:, s], np.arange(4, 9), np.arange(9)[s], "causal", 2)
    want = kernels.attention(q, k, v, np.arange(9) <= np.arange(4, 9)[:, None])
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        found = part(cuts[order[0]])
        for i in order[1:]:
            found = kernels.merge_parts(found, part(cuts[i]))
        np.testing.assert_allclose(found[2] / found[1], want, rtol=1e-9)
    unseen = kernels.attention_part(q, k, v, np.arange(5) - 20, np.arange(9), "causal")
    assert not unseen[1].any() and np.isneginf(unseen[0]).all()
    np.testing.assert_allclose(kernels.merge_parts(unseen, part(slice(0, 9)))[2], part(slice(0, 9))[2])


# regions, pairs and merges


@pytest.mark.parametrize("tile, tolerance", [(4, 0), (7, 0), (5, 1), (64, 0)])
def test_labels_of_tiles(spark, tile, tolerance):
    """Random pixels, a spiral through all tiles, a comb, and coordinates on both sides of 0."""
    rng = np.random.default_rng(tile)
    rows = [(0, y - 10, x - 8, int(rng.integers(0, 3))) for y in range(24) for x in range(20) if rng.random() < 0.7]
    y, x, dy, dx, seen = 0, 0, 0, 1, set()
    for _ in range(400):
        seen.add((y, x))
        if not (0 <= y + dy < 21 and 0 <= x + dx < 21) or (y + 2 * dy, x + 2 * dx) in seen or (y + dy, x + dx) in seen:
            dy, dx = dx, -dy
            if (y + dy, x + dx) in seen or (y + 2 * dy, x + 2 * dx) in seen:
                break
        y, x = y + dy, x + dx
    rows += [(1, y, x, 1) for y, x in seen]
    rows += [(2, y, x, 1) for y in range(20) for x in range(20) if y == 19 or x % 2 == 0]
    frame = spark.createDataFrame([(*r,) for r in rows], "image_id long, y long, x long, v long").repartition(3)
    from gridloom.operators import regions

    want = sorted(regions.label(frame, tolerance).collect())
    assert sorted(regions.label_tiles(frame, tolerance, tile=tile).collect()) == want
    assert len({r.comp for r in want if r.image_id == 1}) == len({r.comp for r in want if r.image_id == 2}) == 1


def test_components(spark):
    from gridloom.operators.unions import components

    edges = [(i, a + 1, a) for i in (0, 1) for a in range(60)] + [(0, 1000, b) for b in range(1001, 1040)] + [(2, 7, 3), (2, 5, 7), (2, 4, 4)]
    got = {(r.image_id, r.node): r.root for r in components(spark.createDataFrame(edges, "image_id long, a long, b long")).collect()}
    want = {(i, a): 0 for i in (0, 1) for a in range(1, 61)} | {(0, b): 1000 for b in range(1001, 1040)} | {(2, 5): 3, (2, 7): 3}
    assert got == want
    assert components(spark.createDataFrame([], "image_id long, a long, b long")).count() == 0


def boxes_of_all_sizes(n=250, seed=2, most=60_000):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        w, h = (int(rng.integers(1, most)) if rng.random() < 0.1 else int(2 ** rng.uniform(0, 12)) for _ in "wh")
        x, y = (int(v) for v in rng.integers(-9000, 9000, 2) // (1 if rng.random() < 0.5 else 30))
        out.append((k % 3 // 2, k, x, y, x + w, y + h))
    return out + [(1, n, 0, 0, 10**9, 10**9), (1, n + 1, -(10**9), 5, 10**9, 6), (1, n + 2, 4, 4, 4, 4)]


@pytest.mark.parametrize("reach", [(0, 0), (11, 0), (3, 5)])
def test_pairs_of_boxes_of_all_sizes(spark, reach):
    from gridloom.operators import boxes

    rows = boxes_of_all_sizes()
    made = boxes.near_pairs(spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long"), reach)
    meet = lambda lo, hi, a, b, r: a[lo] - r <= b[hi] + r and b[lo] - r <= a[hi] + r
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and meet(2, 4, a, b, reach[0]) and meet(3, 5, a, b, reach[1]))
    assert sorted((r.image_id, r.a_box_id, r.b_box_id) for r in made.collect()) == want
    cells = boxes._cells(spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long"), [], reach, boxes.LEVELS)
    assert max(r["count"] for r in cells.groupBy("box_id", "level").count().collect()) <= 25


MERGES = [kernels.merge_meeting, kernels.merge_close, lambda x: kernels.merge_corners(x, True), lambda x: kernels.merge_corners(x, False, (3, 2)), kernels.merge_text]


@pytest.mark.parametrize("how", range(len(MERGES)))
@pytest.mark.parametrize("spread, most", [(3000, 60), (900, 40), (20_000, 4000)])
def test_merges_by_a_grid_are_those_without(monkeypatch, how, spread, most):
    rng = np.random.default_rng(spread)
    corners = rng.integers(-spread, spread, (400, 2))
    sides = np.maximum(1, (most * rng.random((400, 2)) ** 3).astype(int))
    items = [((int(x), int(y), int(x + w), int(y + h)), [k]) for k, ((x, y), (w, h)) in enumerate(zip(corners, sides))]
    found = []
    for few in (10**9, 4):
        monkeypatch.setattr(kernels.Piles, "FEW", few)
        found.append(MERGES[how](items))
    assert found[0] == found[1]


def test_many_boxes_of_an_image_merge_in_time():
    import time

    rng = np.random.default_rng(7)
    corners = rng.integers(0, 60_000, (100_000, 2))
    items = [((x, y, x + 30, y + 12), [k]) for k, (x, y) in enumerate(corners.tolist())]
    for merge in MERGES[:2]:
        began = time.process_time()
        made = merge(items)
        assert sum(len(m) for _, m in made) == len(items) and time.process_time() - began < 60

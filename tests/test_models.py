import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import vectors
from gridloom.operators import kernels, models
from gridloom.operators import vectors as sequences


def test_rope_lengths():
    x = np.random.default_rng(0).standard_normal((20, 32))
    for layout, kept in (("paired", True), ("hhww", False)):
        turned = kernels.rotate(x, models.patch_angles(4, 4, 32, layout))
        assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1)) == kept
        assert np.allclose(turned[:4], x[:4])  # prefix tokens stay


def test_column_functions_are_the_kernels(spark):
    x = np.random.default_rng(1).standard_normal((5, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>")
    out = df.select("k", vectors.rms_norm(F.col("v")).alias("n"), vectors.rotate(F.col("v"), vectors.angles_2d(F.col("k"), F.col("k") * 2, 16)).alias("r"), vectors.swiglu(F.col("v"), *(vectors.matrix(kernels.formula_weights(*s)) for s in ((10, 16, 1), (10, 16, 2), (6, 10, 3)))).alias("s"), vectors.linear(F.col("v"), vectors.matrix(np.eye(16)[:3]), vectors.matrix([[1, 2, 3]])[0]).alias("l")).orderBy("k").collect()
    assert np.allclose([r.l for r in out], x[:, :3] + [1, 2, 3])
    assert np.allclose([r.n for r in out], kernels.rms_norm(x))
    freq = 1e4 ** (-2.0 * np.arange(4) / 8)
    h, w = np.arange(5)[:, None] * freq, 2 * np.arange(5)[:, None] * freq
    assert np.allclose([r.r for r in out], kernels.rotate(x, np.concatenate([h, h, w, w], axis=1)))
    gate, up, down = (kernels.formula_weights(*s) for s in ((10, 16, 1), (10, 16, 2), (6, 10, 3)))
    assert np.allclose([r.s for r in out], (kernels.silu(x @ gate.T) * (x @ up.T)) @ down.T)


def test_attention_rows_are_means():
    rng = np.random.default_rng(2)
    q, k = rng.standard_normal((4, 6, 8)), rng.standard_normal((2, 6, 8))
    ones = np.ones((2, 6, 3))
    below = np.tril(np.ones((6, 6), bool))
    assert np.allclose(kernels.attention(q, k, ones, below), 1)
    v = rng.standard_normal((2, 6, 3))
    out = kernels.attention(q, k, v, below)
    for head in range(4):
        for i in range(6):
            s = np.array([q[head, i] @ k[head // 2, j] / math.sqrt(8) for j in range(i + 1)])
            p = np.exp(s) / np.exp(s).sum()
            assert np.allclose(out[head, i], p @ v[head // 2, : i + 1])


def test_one_layer_does_not_tell_the_masks_apart():
    x = np.random.default_rng(3).standard_normal((3, 64))
    one = [models.fuse(x, models.FuserConfig(layers=1, mask_mode=m)) for m in ("causal", "additive")]
    two = [models.fuse(x, models.FuserConfig(layers=2, mask_mode=m)) for m in ("causal", "additive")]
    assert np.allclose(*one) and not np.allclose(*two)


def test_box_mask_sees_its_patches(spark):
    allowed = models.box_attention_mask(np.array([(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.34, 0.0)]), 4)
    assert allowed[0].all() and allowed[3:].all()
    assert allowed[1].tolist() == [True, True, False] + [True] * 16
    assert allowed[2].tolist() == [True, False, True] + [True, True] + [False] * 14
    boxes = spark.createDataFrame([(1, 0, 0, 0, 400, 300), (1, 1, 790, 590, 800, 600), (1, 2, 10, 10, 12, 12)], "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long")
    got = sequences.box_mask(boxes).groupBy("box_id").count().collect()
    assert {r.box_id: r["count"] for r in got} == {0: 64, 1: 1}


def test_shapes(spark):
    rng = np.random.default_rng(4)
    images = spark.createDataFrame([(k, rng.standard_normal((16, 64)).tolist(), [[0.1, 0.1, 0.6, 0.6]] * 3) for k in range(2)], "image_id long, patches array<array<double>>, boxes array<array<double>>")
    out = models.encode_images(images).collect()
    assert len(out) == 2 * 4 and all(len(r.vec) == 32 for r in out)
    rows = [(1, k, rng.standard_normal(64).tolist()) for k in range(5)]
    boxes = spark.createDataFrame(rows, "image_id long, box_idx long, vec array<double>")
    whole = spark.createDataFrame([(1, [0.5] * 64)], "image_id long, vec array<double>")
    triples = sequences.triples(boxes, whole, whole)
    assert triples.count() == 15
    fused = models.fuse_triples(triples).collect()
    assert len(fused) == 5 and all(len(r.vec) == 64 for r in fused)
    assert models.project_text(np.ones((1, 8)), 8).tolist() == np.ones((1, 8)).tolist()
    assert np.allclose(kernels.gelu(np.array([0.0, 100.0])), [0, 100])


def trained(shapes, seed=7):
    rng = np.random.default_rng(seed)
    return {name: (rng.standard_normal(shape) * 0.3).astype(np.float32) for name, shape in shapes.items()}


def encoder_shapes(dim, patch, depth, mlp, boxes):
    out = {"patch_embed.weight": (dim, *patch), "patch_embed.bias": (dim,), "global_token": (1, 1, dim), "box_tokens": (1, boxes, dim), "norm_final.weight": (dim,)}
    for d in range(depth):
        out |= {f"blocks.{d}.norm{k}.weight": (dim,) for k in (1, 2)}
        out |= {f"blocks.{d}.attn.qkv.weight": (3 * dim, dim), f"blocks.{d}.attn.qkv.bias": (3 * dim,), f"blocks.{d}.attn.proj.weight": (dim, dim)}
        out |= {f"blocks.{d}.mlp.{k}_proj.weight": (mlp * dim, dim) for k in ("gate", "up")} | {f"blocks.{d}.mlp.down_proj.weight": (dim, mlp * dim)}
    return out


def fuser_shapes(dim, heads, kv, mlp, layers):
    out = {"norm.weight": (dim,)}
    for d in range(layers):
        out |= {f"layers.{d}.{k}.weight": (dim,) for k in ("input_layernorm", "post_attention_layernorm")}
        for k, n in (("q", heads), ("k", kv), ("v", kv)):
            out |= {f"layers.{d}.self_attn.{k}_proj.weight": (dim // heads * n, dim), f"layers.{d}.self_attn.{k}_proj.bias": (dim // heads * n,)}
        out |= {f"layers.{d}.self_attn.o_proj.weight": (dim, dim), f"layers.{d}.mlp.down_proj.weight": (dim, mlp)} | {f"layers.{d}.mlp.{k}_proj.weight": (mlp, dim) for k in ("gate", "up")}
    return out


# forward passes number by number, for one sequence


def plain_linear(x, w, b=None):
    return [sum(float(w[o][i]) * x[i] for i in range(len(x))) + (float(b[o]) if b is not None else 0.0) for o in range(len(w))]


def plain_norm(x, w, eps=1e-6):
    return [float(g) * v / math.sqrt(sum(u * u for u in x) / len(x) + eps) for g, v in zip(w, x)]


def plain_turn(x, angles):
    half = len(x) // 2
    return [x[k] * math.cos(angles[k]) + (x[k - half] if k >= half else -x[k + half]) * math.sin(angles[k]) for k in range(len(x))]


def plain_attention(q, k, v, allowed, heads, kv):
    """q, k, v: a list of numbers for each position; k and v have kv heads."""
    each, out = len(q[0]) // heads, []
    for i in range(len(q)):
        row = []
        for h in range(heads):
            g = h // (heads // kv)
            scores = {j: sum(q[i][h * each + c] * k[j][g * each + c] for c in range(each)) / math.sqrt(each) for j in range(len(k)) if allowed(i, j)}
            shares = {j: math.exp(s) for j, s in scores.items()}
            row += [sum(e * v[j][g * each + c] for j, e in shares.items()) / sum(shares.values()) for c in range(each)]
        out.append(row)
    return out


def plain_gated(x, p, name):
    gate, up = (plain_linear(x, p[f"{name}.{k}_proj.weight"]) for k in ("gate", "up"))
    return plain_linear([g / (1 + math.exp(-g)) * u for g, u in zip(gate, up)], p[f"{name}.down_proj.weight"])


def plain_encode(patches, boxes, p, side, dim, heads, depth):
    n, each = len(boxes), dim // heads
    kernel = p["patch_embed.weight"].reshape(dim, -1)
    x = [[float(v) for v in p["global_token"][0, 0]], *([float(v) for v in p["box_tokens"][0, k]] for k in range(n)), *(plain_linear(list(q), kernel, p["patch_embed.bias"]) for q in patches)]
    freq = [1e4 ** (-2 * i / (each // 2)) for i in range(each // 4)]

    def angles(t):
        r, c = divmod(t - 1 - n, side) if t > n else (0, 0)
        return [r * f for f in freq] * 2 + [c * f for f in freq] * 2

    def allowed(i, j):
        if not 1 <= i <= n or j == 0 or j == i:
            return True
        if j <= n:
            return False
        r, c = divmod(j - 1 - n, side)
        x1, y1, x2, y2 = boxes[i - 1]
        return x1 <= c / (side - 1) <= x2 and y1 <= r / (side - 1) <= y2

    def turned(rows):
        return [[v for h in range(heads) for v in plain_turn(row[h * each : (h + 1) * each], angles(t))] for t, row in enumerate(rows)]

    for d in range(depth):
        y = [plain_linear(plain_norm(row, p[f"blocks.{d}.norm1.weight"]), p[f"blocks.{d}.attn.qkv.weight"], p[f"blocks.{d}.attn.qkv.bias"]) for row in x]
        q, k, v = ([row[a * dim : (a + 1) * dim] for row in y] for a in range(3))
        y = plain_attention(turned(q), turned(k), v, allowed, heads, heads)
        x = [[a + b for a, b in zip(row, plain_linear(z, p[f"blocks.{d}.attn.proj.weight"]))] for row, z in zip(x, y)]
        x = [[a + b for a, b in zip(row, plain_gated(plain_norm(row, p[f"blocks.{d}.norm2.weight"]), p, f"blocks.{d}.mlp"))] for row in x]
    return [plain_norm(row, p["norm_final.weight"]) for row in x[: 1 + n]]


def plain_fuse(x, p, heads, kv, layers, base=1e6):
    each = len(x[0]) // heads
    angles = lambda t: [t * base ** (-2 * i / each) for i in range(each // 2)] * 2
    turned = lambda rows, n: [[v for h in range(n) for v in plain_turn(row[h * each : (h + 1) * each], angles(t))] for t, row in enumerate(rows)]
    for d in range(layers):
        y = [plain_norm(row, p[f"layers.{d}.input_layernorm.weight"]) for row in x]
        q, k, v = ([plain_linear(row, p[f"layers.{d}.self_attn.{t}_proj.weight"], p[f"layers.{d}.self_attn.{t}_proj.bias"]) for row in y] for t in "qkv")
        y = plain_attention(turned(q, heads), turned(k, kv), v, lambda i, j: j <= i, heads, kv)
        x = [[a + b for a, b in zip(row, plain_linear(z, p[f"layers.{d}.self_attn.o_proj.weight"]))] for row, z in zip(x, y)]
        x = [[a + b for a, b in zip(row, plain_gated(plain_norm(row, p[f"layers.{d}.post_attention_layernorm.weight"]), p, f"layers.{d}.mlp"))] for row in x]
    return plain_norm(x[-1], p["norm.weight"])


def plain_project(x, p):
    hidden = plain_linear(x, p["vision_projector.0.weight"], p["vision_projector.0.bias"])
    return plain_linear([v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in hidden], p["vision_projector.2.weight"], p["vision_projector.2.bias"])


def test_a_trained_model_end_to_end(spark, tmp_path):
    """Images of three channels, boxes and texts to one vector per box, with all parameters from a table."""
    from gridloom.plans import embed
    from gridloom.sources import weights

    side, size, dim, heads, depth, width = 3, 2, 16, 2, 2, 24
    state = trained(encoder_shapes(dim, (3, size, size), depth, 2, 4))
    state |= {f"llm.{k}": v for k, v in trained(fuser_shapes(width, 4, 2, 20, 2), 8).items()}
    state |= trained({"vision_projector.0.weight": (width, dim), "vision_projector.0.bias": (width,), "vision_projector.2.weight": (width, width), "vision_projector.2.bias": (width,), "text_projector.weight": (width, 10)}, 9)
    weights.write({k: v for k, v in state.items() if "llm" not in k}, spark, str(tmp_path / "w"))
    weights.write({k: v for k, v in state.items() if "llm" in k}, spark, str(tmp_path / "w"), mode="append")
    table = weights.read(spark, str(tmp_path / "w"))
    names = [k.removeprefix("llm.") for k in state if k.startswith("llm.")]
    encoder = models.EncoderConfig(side, 3 * size * size, dim, heads, depth, 2, parameters=weights.Stored(table.filter("name not like 'llm.%'")))
    fuser = models.FuserConfig(width, 4, 2, 20, 2, parameters=weights.Stored(table.filter("name like 'llm.%'"), {k: f"llm.{k}" for k in names}))
    rng = np.random.default_rng(10)
    raster = {i: rng.integers(0, 256, (side * size, side * size, 3)) / 255 for i in (1, 2, 3)}
    boxes = {1: [(0.0, 0.0, 0.6, 0.5), (0.4, 0.4, 1.0, 1.0)], 2: [(0.0, 0.0, 1.0, 1.0)], 3: [(0.0, 0.0, 0.4, 1.0), (0.9, 0.9, 0.95, 0.95)]}
    texts = {i: rng.standard_normal(10).tolist() for i in raster}
    pixels = spark.createDataFrame([(i, y, x, *map(float, a[y, x])) for i, a in raster.items() for y in range(6) for x in range(6)], "image_id long, y long, x long, r double, g double, b double")
    patches = embed.patches(pixels, size, side * size, ("r", "g", "b"))
    images = patches.join(spark.createDataFrame(list(boxes.items()), "image_id long, boxes array<array<double>>".replace("array<array<double>>", "array<struct<a:double,b:double,c:double,d:double>>")), "image_id")
    images = images.withColumn("boxes", F.transform("boxes", lambda b: F.array(b["a"], b["b"], b["c"], b["d"])))
    got = {(r.image_id, r.box_idx): r.vec for r in embed.embed(images, spark.createDataFrame(list(texts.items()), "image_id long, vec array<double>"), encoder, fuser, width).collect()}
    llm = {k.removeprefix("llm."): v for k, v in state.items()}
    for i, a in raster.items():
        cut = [a[r : r + size, c : c + size].transpose(2, 0, 1).ravel() for r in range(0, 6, size) for c in range(0, 6, size)]
        whole, *own = plain_encode(cut, boxes[i], state, side, dim, heads, depth)
        for k, vec in enumerate(own):
            want = plain_fuse([plain_project(vec, state), plain_project(whole, state), plain_linear(texts[i], state["text_projector.weight"])], llm, 4, 2, 2)
            assert np.allclose(got[i, k], want, atol=1e-6)
    assert len(got) == 5


def test_parameters_that_lack_or_do_not_fit(spark, tmp_path):
    from gridloom.sources import weights

    weights.write({"a.weight": np.arange(6.0).reshape(2, 3), "b.bias": np.ones(2)}, spark, str(tmp_path / "w"))
    take = weights.Stored(weights.read(spark, str(tmp_path / "w"), ["a.weight"]))
    assert take("a.weight", 2, 3).tolist() == [[0, 1, 2], [3, 4, 5]] and take("a.bias", 2) is None and take("norm.weight", 3) is None
    for wrong, error in ((("a.weight", 3, 3), ValueError), (("c.weight", 1, 1), KeyError)):
        with pytest.raises(error):
            take(*wrong)


def test_formula_forward_number_by_number():
    """The registered queries' models, whose parameters come from the formula, against the same plain passes."""
    rng, formula = np.random.default_rng(11), models.Formula()
    c = models.EncoderConfig()
    p = {k: formula(k, *(s if len(s) < 3 or "token" in k else (s[0], 64))) for k, s in encoder_shapes(c.dim, (1, 8, 8), c.depth, c.mlp, 2).items()}
    p = {k: v if v is not None else np.ones(32) if "norm" in k else np.zeros(encoder_shapes(32, (1, 8, 8), 2, 4, 2)[k]) for k, v in p.items()}
    patches, boxes = rng.standard_normal((16, 64)), [(0.1, 0.1, 0.7, 0.4), (0.0, 0.0, 1.0, 1.0)]
    whole, own = models.encode(patches, np.array(boxes), c)
    assert np.allclose([whole, *own], plain_encode(patches, boxes, p, 4, 32, 4, 2), atol=1e-9)
    f = models.FuserConfig()
    shapes = fuser_shapes(64, 4, 2, 128, 2)
    p = {k: v if (v := formula(k, *s)) is not None else np.ones(s) if "norm" in k else np.zeros(s) for k, s in shapes.items()}
    x = rng.standard_normal((3, 64))
    assert np.allclose(models.fuse(x, f), plain_fuse(x.tolist(), p, 4, 2, 2), atol=1e-9)


def test_patches(spark):
    from gridloom.plans import embed

    df = spark.createDataFrame([(1, y, x, y * 4 + x) for y in range(4) for x in range(4)], "image_id long, y long, x long, v long")
    assert embed.patches(df, 2, 4).first().patches == [[0, 1, 4, 5], [2, 3, 6, 7], [8, 9, 12, 13], [10, 11, 14, 15]]


@pytest.mark.parametrize("mask_mode", ["causal", "none", "additive"])
def test_attention_in_blocks_is_the_dense_product(mask_mode):
    rng = np.random.default_rng(5)
    q, k, v = (rng.standard_normal((heads, 150, 8)) * 3 for heads in (4, 2, 2))
    below = np.tril(np.ones((150, 150), bool))
    dense = kernels.attention(q, k, v, below if mask_mode == "causal" else None, below.astype(float) if mask_mode == "additive" else None)
    for block in (1, 64, 150, 512):
        assert np.allclose(kernels.attention_in_blocks(q, k, v, mask_mode, block), dense)


@pytest.fixture(scope="module")
def long_labels(spark, tmp_path_factory):
    """A folder with embeddings of labels of 150 and 70 rows, and the vectors of each label in order."""
    x = np.random.default_rng(6).standard_normal((220, 64)).astype(np.float32)
    label = [0 if k % 22 < 15 else 1 for k in range(220)]
    at = str(tmp_path_factory.mktemp("long"))
    rows = [(k, x[k].tolist(), label[k]) for k in range(220)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, {b: x[[k for k in range(220) if label[k] == b]].astype(float) for b in (0, 1)}


@pytest.mark.parametrize("name, kv", [("attn_masked", 4), ("attn_gqa", 2)])
def test_sequences_are_whole_labels(spark, long_labels, name, kv):
    from gridloom.plans import registry

    at, by_label = long_labels
    got = {(r.seq, r["pos"], r["head"], r.i): r.y for r in registry.QUERIES[name](spark, at).collect()}
    assert len(got) == 220 * 64
    for label, x in by_label.items():
        q = models.split(x, 4)
        out = kernels.attention(q, q[:kv], q[:kv], np.tril(np.ones((len(x), len(x)), bool)))
        made = [[[got[label * 1000000, p, h, i] for i in range(16)] for p in range(len(x))] for h in range(4)]
        assert np.allclose(made, out, atol=1e-6)


def test_rotation_goes_on_along_a_label(spark, long_labels):
    from gridloom.plans import registry

    at, by_label = long_labels
    got = {(r.vec_id, r.i): r.y for r in registry.QUERIES["vec_rope_1d"](spark, at).collect()}
    one = np.arange(150)[:, None] * 1e6 ** (-2.0 * np.arange(32) / 64)
    turned = kernels.rotate(by_label[0], np.concatenate([one, one], axis=1))
    ids = [k for k in range(220) if k % 22 < 15]
    assert np.allclose([[got[k, i] for i in range(64)] for k in ids], turned, atol=1e-6)


def test_all_vectors_are_encoded(spark, long_labels):
    from gridloom.plans import registry

    at, by_label = long_labels
    got = {(r.image_id, r.tok, r.i): r.y for r in registry.QUERIES["encoder_forward"](spark, at).collect()}
    boxes, c = np.array([(0.1, 0.1, 0.7, 0.4), (0.0, 0.0, 1.0, 1.0)]), models.EncoderConfig()
    assert len(got) == (10 + 5) * 3 * c.dim
    for label, x in by_label.items():
        padded = np.concatenate([x, np.zeros((-len(x) % 16, 64))]).reshape(-1, 16, 64)
        for k, patches in enumerate(padded):
            whole, own = models.encode(patches, boxes, c)
            made = [[got[label * 1000000 + k, t, i] for i in range(c.dim)] for t in range(3)]
            assert np.allclose(made, [whole, *own], atol=1e-6)

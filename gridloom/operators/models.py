"""Forward passes of the embedding models, in numpy over Arrow batches.

A model asks for its parameters by name and shape: matrices and biases of its
linear maps, weights of its norms, its learned tokens.  They come from
sources.weights.Stored (a trained model's, mapped into memory once an
executor) or, by default, from the fixtures' formula.  Rows of equal shape in a
batch are one product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: (name, shape) -> the parameter, or None for a bias, norm weight or token that the model doesn't have.
Parameters = Callable[..., "np.ndarray | None"]


class Formula:
    """The fixtures' parameters: matrices by a formula of their layer; no biases, norm weights or learned tokens."""

    _BLOCK = {"qkv": 0, "q_proj": 0, "k_proj": 1, "v_proj": 2, "proj": 3, "o_proj": 3, "gate_proj": 4, "up_proj": 5, "down_proj": 6}
    _ALONE = {"patch_embed": 0, "vision_projector.0": 0, "vision_projector.2": 1, "text_projector": 2}

    def __call__(self, name: str, *shape: int) -> np.ndarray | None:
        of, _, kind = name.rpartition(".")
        if kind != "weight" or "norm" in of:
            return None
        if of in self._ALONE:
            return kernels.formula_weights(*shape, self._ALONE[of])
        first, number, *_, last = of.split(".")
        layer = 10 * int(number) + (first == "blocks") + self._BLOCK[last]
        if last == "qkv":  # three matrices in one
            return np.concatenate([kernels.formula_weights(shape[0] // 3, shape[1], layer + j) for j in range(3)])
        return kernels.formula_weights(*shape, layer)


@dataclass(frozen=True)
class EncoderConfig:
    side: int = 4  # patches along a side
    patch: int = 64  # numbers of a patch: channels, rows, columns
    dim: int = 32
    heads: int = 4
    depth: int = 2
    mlp: int = 4
    layout: str = "hhww"
    eps: float = 1e-6
    parameters: Parameters = Formula()


@dataclass(frozen=True)
class FuserConfig:
    dim: int = 64
    heads: int = 4
    kv_heads: int = 2
    mlp: int = 128
    layers: int = 2
    rope_base: float = 1e6
    eps: float = 1e-6
    mask_mode: str = "causal"
    parameters: Parameters = Formula()


def linear(x: np.ndarray, p: Parameters, name: str, out: int) -> np.ndarray:
    return kernels.linear(x, p(f"{name}.weight", out, x.shape[-1]), p(f"{name}.bias", out))


def swiglu(x: np.ndarray, hidden: int, p: Parameters, name: str) -> np.ndarray:
    gate, up = (linear(x, p, f"{name}.{k}_proj", hidden) for k in ("gate", "up"))
    return linear(kernels.silu(gate) * up, p, f"{name}.down_proj", x.shape[-1])


def split(x: np.ndarray, heads: int) -> np.ndarray:
    """(..., positions, dim) -> (..., heads, positions, dim / heads)."""
    return np.swapaxes(x.reshape(*x.shape[:-1], heads, -1), -2, -3)


def joined(x: np.ndarray) -> np.ndarray:
    x = np.swapaxes(x, -2, -3)
    return x.reshape(*x.shape[:-2], -1)


def patch_angles(side: int, prefix: int, dim: int, layout: str, base: float = 1e4) -> np.ndarray:
    """Of the prefix tokens (at 0, 0, so unturned) and of the patches by row and column."""
    half = dim // 2
    freq = base ** (-2.0 * np.arange(half // 2) / half)
    rows, cols = np.divmod(np.arange(side * side), side)
    h, w = rows[:, None] * freq, cols[:, None] * freq
    order = [h, h, w, w] if layout == "hhww" else [h, w, h, w]
    return np.concatenate([np.zeros((prefix, dim)), np.concatenate(order, axis=1)])


def box_attention_mask(boxes: np.ndarray, side: int) -> np.ndarray:
    """allowed[..., query, key] over global, boxes, patches: all see all, but a box sees the global token, itself and its patches only."""
    n, at = boxes.shape[-2], np.arange(side) / (side - 1)
    x1, y1, x2, y2 = (boxes[..., k, None] for k in range(4))
    inside = ((at >= y1) & (at <= y2))[..., :, None] & ((at >= x1) & (at <= x2))[..., None, :]
    allowed = np.ones((*boxes.shape[:-2], *((1 + n + side * side,) * 2)), bool)
    allowed[..., 1 : 1 + n, 1 : 1 + n] = np.eye(n, dtype=bool)
    allowed[..., 1 : 1 + n, 1 + n :] = inside.reshape(*boxes.shape[:-1], side * side)
    return allowed


def encode(patches: np.ndarray, boxes: np.ndarray, c: EncoderConfig) -> tuple[np.ndarray, np.ndarray]:
    """(global vector, a vector for each box) of images' patches (..., side * side, patch) and boxes (..., n, 4) in parts of the image."""
    p, n, batch = c.parameters, boxes.shape[-2], patches.shape[:-2]
    tokens = [np.zeros((*batch, k, c.dim)) if t is None else np.broadcast_to(t[..., :k, :], (*batch, k, c.dim)) for k, t in ((1, p("global_token", 1, 1, c.dim)), (n, p("box_tokens", 1, n, c.dim)))]
    x = np.concatenate([*tokens, linear(patches, p, "patch_embed", c.dim)], axis=-2)
    angles = patch_angles(c.side, 1 + n, c.dim // c.heads, c.layout)
    allowed = box_attention_mask(boxes, c.side)[..., None, :, :]
    for d in range(c.depth):
        name = f"blocks.{d}"
        y = kernels.rms_norm(x, p(f"{name}.norm1.weight", c.dim), c.eps)
        q, k, v = (split(part, c.heads) for part in np.split(linear(y, p, f"{name}.attn.qkv", 3 * c.dim), 3, axis=-1))
        y = kernels.attention(kernels.rotate(q, angles), kernels.rotate(k, angles), v, allowed)
        x = x + linear(joined(y), p, f"{name}.attn.proj", c.dim)
        x = x + swiglu(kernels.rms_norm(x, p(f"{name}.norm2.weight", c.dim), c.eps), c.mlp * c.dim, p, f"{name}.mlp")
    x = kernels.rms_norm(x, p("norm_final.weight", c.dim), c.eps)
    return x[..., 0, :], x[..., 1 : 1 + n, :]


def project(x: np.ndarray, hidden: int, out: int, p: Parameters = Formula()) -> np.ndarray:
    """Linear, exact GELU, linear."""
    return linear(kernels.gelu(linear(x, p, "vision_projector.0", hidden)), p, "vision_projector.2", out)


def project_text(x: np.ndarray, out: int, p: Parameters = Formula()) -> np.ndarray:
    """As it is if it has the width wanted, else a linear map."""
    return x if x.shape[-1] == out else linear(x, p, "text_projector", out)


def fuse(triples: np.ndarray, c: FuserConfig) -> np.ndarray:
    """The last token's vector after the decoder layers over short sequences (..., slots, dim)."""
    x, p = np.asarray(triples, float), c.parameters
    n, each = x.shape[-2], c.dim // c.heads
    one = np.arange(n)[:, None] * c.rope_base ** (-2.0 * np.arange(each // 2) / each)
    angles = np.concatenate([one, one], axis=1)
    below = np.tril(np.ones((n, n), bool))
    allowed, added = (below, None) if c.mask_mode == "causal" else (None, below.astype(float))
    for d in range(c.layers):
        name = f"layers.{d}"
        y = kernels.rms_norm(x, p(f"{name}.input_layernorm.weight", c.dim), c.eps)
        q, k, v = (split(linear(y, p, f"{name}.self_attn.{t}_proj", each * heads), heads) for t, heads in (("q", c.heads), ("k", c.kv_heads), ("v", c.kv_heads)))
        y = kernels.attention(kernels.rotate(q, angles), kernels.rotate(k, angles), v, allowed, added)
        x = x + linear(joined(y), p, f"{name}.self_attn.o_proj", c.dim)
        x = x + swiglu(kernels.rms_norm(x, p(f"{name}.post_attention_layernorm.weight", c.dim), c.eps), c.mlp, p, f"{name}.mlp")
    return kernels.rms_norm(x, p("norm.weight", c.dim), c.eps)[..., -1, :]


# frames


def _flat(column) -> np.ndarray:
    """The numbers of a column of lists, or of lists of lists."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    while pa.types.is_list(array.type):
        array = array.flatten()
    return array.to_numpy(zero_copy_only=False).astype(float)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), np.ascontiguousarray(rows, dtype=float).reshape(-1))


#: Numbers of the intermediate values that rows worked on together may have, about.
TOGETHER = 1_000_000


def _cut(batches, each: int):
    """Batches of so many rows that their vectors have TOGETHER numbers at most, as what Python holds shouldn't grow with Arrow's batches."""
    rows = max(1, TOGETHER // each)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _alike(sizes: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """Places of rows of one size, a bounded number at a time."""
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield from np.array_split(at, max(1, len(at) * each // TOGETHER))


def encode_images(images: DataFrame, config: EncoderConfig = EncoderConfig()) -> DataFrame:
    """image_id, tok (0 global, 1.. boxes), vec of images (image_id, patches array<array<double>>, boxes array<array<double>>)."""
    names, n_patches = ["image_id", "tok", "vec"], config.side * config.side

    def run(batches):
        for batch in _cut(batches, n_patches * config.patch):
            ids, counts = batch["image_id"].to_numpy(zero_copy_only=False), batch["boxes"].value_lengths().to_numpy()
            patches = _flat(batch["patches"]).reshape(-1, n_patches, config.patch)
            corners, first = _flat(batch["boxes"]).reshape(-1, 4), np.cumsum(counts) - counts
            for at in _alike(counts, (n_patches + 8) * config.dim * config.mlp * 3) if len(ids) else ():
                n = int(counts[at[0]])
                whole, own = encode(patches[at], corners[first[at][:, None] + np.arange(n)].reshape(len(at), n, 4), config)
                made = np.concatenate([whole[:, None], own], axis=1).reshape(-1, config.dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], n + 1)), pa.array(np.tile(np.arange(n + 1, dtype=np.int32), len(at))), _lists(made)], names)

    shaped = images.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("array<array<double>>").alias(c) for c in ("patches", "boxes")])
    return shaped.mapInArrow(run, "image_id long, tok int, vec array<double>")


#: Numbers that a row of a product may have, about, between its matrices.
MOST_WIDE = 256


def map_vectors(rows: DataFrame, key: str, of) -> DataFrame:
    """key, vec: `of` of the vectors, as the rows of a matrix; a batch is one product."""

    def run(batches):
        for batch in _cut(batches, MOST_WIDE):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch[key], _lists(of(_flat(batch["vec"]).reshape(batch.num_rows, -1)))], [key, "vec"])

    return rows.select(key, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, vec array<double>")


def project_vectors(rows: DataFrame, key: str, hidden: int, out: int, parameters: Parameters = Formula()) -> DataFrame:
    return map_vectors(rows, key, lambda x: project(x, hidden, out, parameters))


def project_texts(rows: DataFrame, key: str, out: int, parameters: Parameters = Formula()) -> DataFrame:
    return map_vectors(rows, key, lambda x: project_text(x, out, parameters))


def linear_vectors(rows: DataFrame, key: str, out: int, name: str, parameters: Parameters) -> DataFrame:
    return map_vectors(rows, key, lambda x: linear(x, parameters, name, out))


def swiglu_vectors(rows: DataFrame, key: str, hidden: int, name: str, parameters: Parameters) -> DataFrame:
    return map_vectors(rows, key, lambda x: swiglu(x, hidden, parameters, name))


def fuse_triples(rows: DataFrame, config: FuserConfig = FuserConfig()) -> DataFrame:
    """image_id, box_idx, vec: one vector for each triple of (image_id, box_idx, slot, vec)."""
    triples = rows.groupBy(F.col("image_id").cast("long").alias("image_id"), F.col("box_idx").cast("long").alias("box_idx")).agg(F.array_sort(F.collect_list(F.struct("slot", "vec"))).alias("t"))
    names = ["image_id", "box_idx", "vec"]

    def run(batches):
        for batch in _cut(batches, 4 * config.dim):
            slots = batch["vecs"].value_lengths().to_numpy()
            flat, first = _flat(batch["vecs"]).reshape(-1, config.dim), np.cumsum(slots) - slots
            for at in _alike(slots, 3 * config.mlp * 3) if batch.num_rows else ():
                made = fuse(flat[first[at][:, None] + np.arange(slots[at[0]])], config)
                keys = [batch[c].take(pa.array(at)) for c in names[:2]]
                yield pa.RecordBatch.from_arrays([*keys, _lists(made)], names)

    shaped = triples.select("image_id", "box_idx", F.col("t.vec").cast("array<array<double>>").alias("vecs"))
    return shaped.mapInArrow(run, "image_id long, box_idx long, vec array<double>")

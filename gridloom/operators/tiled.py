"""Forward passes with weights beyond an executor: matrices and activations as rows of tiles.

A matrix is a table of tiles (name, o, k, data): rows o and columns k of a grid
of `tile` x `tile` numbers.  Activations are in groups of some thousand rows,
cut into tiles of `tile` columns: (grp, tile, n, data).  A product's task takes
a group's tiles, as many columns as TOGETHER allows, and the weights of as many
output tiles, and adds what belongs to an output tile in the order of k.  Where
the columns are more than a task takes, the sums of the parts are added in a
second step.  What follows the sum happens in the same place: the division by a
row's root mean square, a bias, the gate of a gated unit, the residual.  So a
product moves its activations once for as many output tiles as a task takes,
the weights once for each group, and no task holds more than about TOGETHER of
activations and as much of weights and results, or one group's heads of
attention.

Between layers the activations are checkpointed: a lost executor costs a layer
at most, and a plan never holds more than one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from . import kernels
from .models import FuserConfig, Parameters, _flat, _lists, joined, split

#: Side of a tile; rows of activations in a group, about.
TILE, GROUP_ROWS = 1024, 4096
_TILES = "name string, o int, k int, data binary"
_ACTIVATIONS = "grp long, tile int, n int, data binary"
_PARTS = "grp long, tile int, name string, k_part int, n int, part binary, squares binary"
_ACTIVATION_FIELDS = pa.schema([("grp", pa.int64()), ("tile", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_PART_FIELDS = pa.schema([("grp", pa.int64()), ("tile", pa.int32()), ("name", pa.string()), ("k_part", pa.int32()), ("n", pa.int32()), ("part", pa.binary()), ("squares", pa.binary())])
#: Bytes of a group's activations that a product's task takes, and of the weights and results that it has to do with.
TOGETHER = 1 << 28


def _matrix(data, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1)


def _n_tiles(width: int, tile: int) -> int:
    return -(-width // tile)


# weights


def tiles_by_rule(spark: SparkSession, shapes: dict[str, tuple[int, int]], parameters: Parameters, tile: int = TILE) -> DataFrame:
    """Tiles of the matrices (rows, columns) by name, each made on an executor from `parameters` (of sources.weights.Stored only its pages are read)."""
    ids = [(name, o, k) for name, (rows, columns) in shapes.items() for o in range(_n_tiles(rows, tile)) for k in range(_n_tiles(columns, tile))]

    def run(batches):
        for batch in batches:
            for name, o, k in zip(*(batch[c].to_pylist() for c in ("name", "o", "k"))):
                data = np.ascontiguousarray(parameters(f"{name}.weight", *shapes[name])[o * tile : (o + 1) * tile, k * tile : (k + 1) * tile], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([o], pa.int32()), pa.array([k], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["name", "o", "k", "data"])

    spread = spark.createDataFrame(ids, "name string, o int, k int").repartition(min(len(ids), 4 * spark.sparkContext.defaultParallelism))
    return spread.mapInArrow(run, _TILES)


def tiles_of(table: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of the matrices in a table of parameters (name, shape, kind, data); names lose their `.weight`."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                name, shape, kind = (batch[c][row].as_py() for c in ("name", "shape", "kind"))
                a = np.frombuffer(batch["data"][row].as_buffer(), np.dtype(kind)).reshape(shape[0], -1)
                for o in range(_n_tiles(a.shape[0], tile)):
                    for k in range(_n_tiles(a.shape[1], tile)):
                        data = np.ascontiguousarray(a[o * tile : (o + 1) * tile, k * tile : (k + 1) * tile], np.float64)
                        yield pa.RecordBatch.from_arrays([pa.array([name.removesuffix(".weight")]), pa.array([o], pa.int32()), pa.array([k], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["name", "o", "k", "data"])

    matrices = table.filter((F.size("shape") > 1) & F.col("name").endswith(".weight")).select("name", "shape", "kind", "data")
    return matrices.mapInArrow(run, _TILES)


# products

#: (matrices by name, the residual's tile or None, first column of the tile) -> the tile of the result.
Finish = Callable[[dict[str, np.ndarray], "np.ndarray | None", int], np.ndarray]


def multiply(x: DataFrame, tiles: DataFrame, names: list[str], finish: Finish, tile: int, shape: tuple[int, int], groups: tuple[int, int], norm: np.ndarray | None = None, eps: float | None = None, residual: DataFrame | None = None) -> DataFrame:
    """finish(x @ W.T for each name's W, of the given shape) of activations x, tile by tile.

    groups: how many groups there are (numbered from 0), and their rows, about.
    With eps, x is taken divided by its rows' root mean square and, if norm is
    given, times it; the division is made after the sum, as it is the same for
    a whole row.
    """
    n_out, n_in = (_n_tiles(side, tile) for side in shape)
    n_groups, group_rows = groups
    k_span = max(1, min(n_in, TOGETHER // (8 * tile * group_rows)))
    o_span = max(1, min(n_out, TOGETHER // (8 * tile * len(names) * (group_rows + k_span * tile))))
    n_parts, whole = -(-n_out // o_span), k_span == n_in
    part_of = lambda c, span: F.floor(F.col(c) / span).cast("int")
    every = lambda n, kind: F.explode(F.sequence(F.lit(0).cast(kind), F.lit(n - 1).cast(kind)))
    none = F.lit(0)
    left = x.select("grp", every(n_parts, "int").alias("part"), part_of("tile", k_span).alias("k_part"), F.lit("x").alias("kind"), F.lit("").alias("name"), none.alias("o"), F.col("tile").alias("k"), "n", "data")
    right = tiles.filter(F.col("name").isin(names)).select(every(n_groups, "long").alias("grp"), part_of("o", o_span).alias("part"), part_of("k", k_span).alias("k_part"), F.lit("w").alias("kind"), "name", "o", "k", none.alias("n"), "data")
    rows = left.unionByName(right)
    if whole and residual is not None:
        rows = rows.unionByName(residual.select("grp", part_of("tile", o_span).alias("part"), none.alias("k_part"), F.lit("residual").alias("kind"), F.lit("").alias("name"), F.col("tile").alias("o"), none.alias("k"), "n", "data"))

    def divided(found: dict[str, np.ndarray], squares: np.ndarray) -> dict[str, np.ndarray]:
        return found if eps is None else {name: y / np.sqrt(squares / shape[1] + eps)[:, None] for name, y in found.items()}

    def products(table: pa.Table) -> pa.Table:
        kinds, at = table["kind"].to_pylist(), {c: table[c].to_pylist() for c in ("name", "o", "k", "n")}
        found = lambda kind: sorted((at["o"][r], at["name"][r], at["k"][r], r) for r, of in enumerate(kinds) if of == kind)
        data = lambda r, n: _matrix(table["data"][r].as_buffer(), n)
        n = max(at["n"])
        a = {k: data(r, n) for _, _, k, r in found("x")}
        if not a:  # no row has come to this group
            return (_ACTIVATION_FIELDS if whole else _PART_FIELDS).empty_table()
        squares = sum(((a[k] * a[k]).sum(axis=1) for k in sorted(a)), np.zeros(n)) if eps is not None else np.zeros(0)
        if norm is not None:
            a = {k: m * norm[k * tile : k * tile + m.shape[1]] for k, m in a.items()}
        before = {o: r for o, _, _, r in found("residual")}
        grp, k_part = table["grp"][0].as_py(), table["k_part"][0].as_py()
        out = []
        for o, of_tile in itertools.groupby(found("w"), lambda w: w[0]):
            sums: dict[str, np.ndarray] = {}
            for _, name, k, r in of_tile:
                y = a[k] @ np.frombuffer(table["data"][r].as_buffer(), np.float64).reshape(-1, a[k].shape[1]).T
                sums[name] = sums[name] + y if name in sums else y
            if whole:
                y = finish(divided(sums, squares), data(before[o], n) if o in before else None, o * tile)
                out.append((grp, o, n, np.ascontiguousarray(y).tobytes()))
            else:
                out += [(grp, o, name, k_part, n, y.tobytes(), squares.tobytes()) for name, y in sums.items()]
        schema = _ACTIVATION_FIELDS if whole else _PART_FIELDS
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    made = rows.groupBy("grp", "part", "k_part").applyInArrow(products, _ACTIVATIONS if whole else _PARTS)
    if whole:
        return made

    def summed(parts: pa.Table, kept: pa.Table | None) -> pa.Table:
        sums: dict[str, np.ndarray] = {}
        squares: dict[int, np.ndarray] = {}
        n = parts["n"][0].as_py()
        for row in parts.sort_by([("name", "ascending"), ("k_part", "ascending")]).to_pylist():
            name, y = row["name"], _matrix(row["part"], n)
            sums[name] = sums[name] + y if name in sums else y
            squares[row["k_part"]] = np.frombuffer(row["squares"], np.float64)
        before = _matrix(kept["data"][0].as_buffer(), n) if kept is not None and kept.num_rows else None
        o = parts["tile"][0].as_py()
        out = np.ascontiguousarray(finish(divided(sums, sum(squares.values())), before, o * tile))
        return pa.table({"grp": parts["grp"].slice(0, 1), "tile": parts["tile"].slice(0, 1), "n": parts["n"].slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})

    by = made.groupBy("grp", "tile")
    if residual is None:
        return by.applyInArrow(lambda parts: summed(parts, None), _ACTIVATIONS)
    return by.cogroup(residual.groupBy("grp", "tile")).applyInArrow(summed, _ACTIVATIONS)


def plain(names: list[str], biases: dict[str, np.ndarray | None]) -> Finish:
    """The sum of the residual, the one product and its bias."""

    def finish(found, before, first):
        y = found[names[0]]
        bias = biases.get(names[0])
        y = y if bias is None else y + bias[first : first + y.shape[1]]
        return y if before is None else before + y

    return finish


def gated(gate: str, up: str, biases: dict[str, np.ndarray | None]) -> Finish:
    """silu(gate) * up."""
    one, other = plain([gate], biases), plain([up], biases)
    return lambda found, before, first: kernels.silu(one(found, None, first)) * other(found, None, first)


# attention


def attend(q: DataFrame, k: DataFrame, v: DataFrame, each: int, shared: int, slots: int, base: float, mask_mode: str, tile: int) -> DataFrame:
    """Attention within sequences of `slots` rows that follow each other in a group, head group by head group: `shared` query heads of `each` numbers to one of keys and values."""
    wide = {"q": each * shared, "k": each, "v": each}

    def pieces(kind: str):
        """Columns of a tile by the head group that they belong to."""

        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    n, at = batch["n"][row].as_py(), batch["tile"][row].as_py() * tile
                    a = _matrix(batch["data"][row].as_buffer(), n)
                    for head in range(at // wide[kind], (at + a.shape[1] - 1) // wide[kind] + 1):
                        lo, hi = max(at, head * wide[kind]), min(at + a.shape[1], (head + 1) * wide[kind])
                        part = np.ascontiguousarray(a[:, lo - at : hi - at])
                        yield pa.RecordBatch.from_arrays([batch["grp"].slice(row, 1), pa.array([head], pa.int32()), pa.array([kind]), pa.array([lo], pa.int32()), pa.array([n], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["grp", "head", "kind", "first", "n", "data"])

        return run

    schema = "grp long, head int, kind string, first int, n int, data binary"
    split_up = [x.mapInArrow(pieces(kind), schema) for kind, x in (("q", q), ("k", k), ("v", v))]
    one = np.arange(slots)[:, None] * base ** (-2.0 * np.arange(each // 2) / each)
    angles = np.concatenate([one, one], axis=1)
    below = np.tril(np.ones((slots, slots), bool))
    allowed, added = (below, None) if mask_mode == "causal" else (None, below.astype(float))

    def run(table: pa.Table) -> pa.Table:
        n, head = table["n"][0].as_py(), table["head"][0].as_py()
        rows = table.sort_by([("kind", "ascending"), ("first", "ascending")]).to_pylist()
        whole = {kind: np.concatenate([_matrix(r["data"], n) for r in rows if r["kind"] == kind], axis=1).reshape(n // slots, slots, -1) for kind in wide}
        y = kernels.attention(kernels.rotate(split(whole["q"], shared), angles), kernels.rotate(split(whole["k"], 1), angles), split(whole["v"], 1), allowed, added)
        y = joined(y).reshape(n, -1)
        first = head * wide["q"]
        cuts = [first, *range((first // tile + 1) * tile, first + y.shape[1], tile), first + y.shape[1]]
        made = [(lo // tile, lo, np.ascontiguousarray(y[:, lo - first : hi - first]).tobytes()) for lo, hi in zip(cuts, cuts[1:])]
        return pa.table({"grp": pa.array([table["grp"][0].as_py()] * len(made), pa.int64()), "tile": pa.array([t for t, _, _ in made], pa.int32()), "first": pa.array([f for _, f, _ in made], pa.int32()), "n": pa.array([n] * len(made), pa.int32()), "data": pa.array([d for *_, d in made], pa.binary())})

    def side_by_side(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        whole = np.concatenate([_matrix(r["data"], n) for r in table.sort_by("first").to_pylist()], axis=1)
        return pa.table({"grp": table["grp"].slice(0, 1), "tile": table["tile"].slice(0, 1), "n": table["n"].slice(0, 1), "data": pa.array([np.ascontiguousarray(whole).tobytes()], pa.binary())})

    heads = split_up[0].unionByName(split_up[1]).unionByName(split_up[2]).groupBy("grp", "head").applyInArrow(run, "grp long, tile int, first int, n int, data binary")
    return heads.groupBy("grp", "tile").applyInArrow(side_by_side, _ACTIVATIONS)


# the decoder


def shapes_of(c: FuserConfig) -> dict[str, tuple[int, int]]:
    """The decoder's matrices."""
    kv = c.dim // c.heads * c.kv_heads
    sizes = {"self_attn.q_proj": (c.dim, c.dim), "self_attn.k_proj": (kv, c.dim), "self_attn.v_proj": (kv, c.dim), "self_attn.o_proj": (c.dim, c.dim), "mlp.gate_proj": (c.mlp, c.dim), "mlp.up_proj": (c.mlp, c.dim), "mlp.down_proj": (c.dim, c.mlp)}
    return {f"layers.{d}.{name}": shape for d in range(c.layers) for name, shape in sizes.items()}


def fuse_triples(rows: DataFrame, c: FuserConfig = FuserConfig(), tiles: DataFrame | None = None, tile: int = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """models.fuse_triples with matrices as tiles: image_id, box_idx, vec of each triple of (image_id, box_idx, slot, vec).

    tiles: of the matrices (by default by c.parameters, which also give the
    norms' weights and biases: vectors of the model's width).
    """
    spark = rows.sparkSession
    tiles = cut(tiles if tiles is not None else tiles_by_rule(spark, shapes_of(c), c.parameters, tile))
    triples = rows.groupBy(F.col("image_id").cast("long").alias("image_id"), F.col("box_idx").cast("long").alias("box_idx")).agg(F.array_sort(F.collect_list(F.struct("slot", "vec"))).alias("t"))
    triples = cut(triples.select("image_id", "box_idx", F.size("t").alias("slots"), F.col("t.vec").cast("array<array<double>>").alias("vecs")))
    counts = {r["slots"]: r["count"] for r in triples.groupBy("slots").count().collect()}  # sequences are short: a few lengths
    names = ["image_id", "box_idx", "vec"]
    found = spark.createDataFrame([], "image_id long, box_idx long, vec array<double>")
    for slots, count in sorted(counts.items()):
        n_groups = -(-count * slots // group_rows)
        own = triples.filter(F.col("slots") == slots).withColumn("grp", F.pmod(F.xxhash64("image_id", "box_idx"), F.lit(n_groups)))

        def cut_up(table: pa.Table) -> pa.Table:
            table = table.sort_by([("image_id", "ascending"), ("box_idx", "ascending")])
            x = _flat(table["vecs"]).reshape(-1, c.dim)
            parts = [np.ascontiguousarray(x[:, a : a + tile]).tobytes() for a in range(0, c.dim, tile)]
            keys = np.stack([table[k].to_numpy() for k in names[:2]]).astype(np.int64).tobytes()
            n = len(parts)
            return pa.table({"grp": pa.array([table["grp"][0].as_py()] * n, pa.int64()), "tile": pa.array(range(n), pa.int32()), "n": pa.array([len(x)] * n, pa.int32()), "data": pa.array(parts, pa.binary()), "keys": pa.array([keys, *[None] * (n - 1)], pa.binary())})

        start = cut(own.select("grp", *names[:2], "vecs").groupBy("grp").applyInArrow(cut_up, _ACTIVATIONS + ", keys binary"))
        x = start.drop("keys")
        for d in range(c.layers):
            x = cut(layer(x, tiles, d, c, slots, tile, (n_groups, group_rows)))
        norm = c.parameters("norm.weight", c.dim)

        def last(keyed: pa.Table, parts: pa.Table) -> pa.Table:
            n = parts["n"][0].as_py()
            y = np.concatenate([_matrix(r["data"], n) for r in parts.sort_by("tile").to_pylist()], axis=1)[slots - 1 :: slots]
            ids = np.frombuffer(keyed["keys"][0].as_buffer(), np.int64).reshape(2, -1)
            return pa.Table.from_arrays([pa.array(ids[0]), pa.array(ids[1]), _lists(kernels.rms_norm(y, norm, c.eps))], names)

        keyed = start.filter(F.col("keys").isNotNull()).select("grp", "keys")
        found = found.unionByName(keyed.groupBy("grp").cogroup(x.groupBy("grp")).applyInArrow(last, "image_id long, box_idx long, vec array<double>"))
    return found


def layer(x: DataFrame, tiles: DataFrame, d: int, c: FuserConfig, slots: int, tile: int, groups: tuple[int, int]) -> DataFrame:
    """One decoder layer."""
    each, p = c.dim // c.heads, c.parameters
    name = lambda k: f"layers.{d}.{k}"
    shapes = shapes_of(c)
    biases = {k: p(f"{k}.bias", shape[0]) for k, shape in shapes.items() if k.startswith(f"layers.{d}.")}
    first, second = (p(f"{name(k)}.weight", c.dim) for k in ("input_layernorm", "post_attention_layernorm"))
    product = lambda x, names, finish, *norm, residual=None: multiply(x, tiles, names, finish, tile, shapes[names[0]], groups, *norm, residual=residual)
    q, k, v = (product(x, [one], plain([one], biases), first, c.eps) for one in (name(f"self_attn.{t}_proj") for t in "qkv"))
    mixed = attend(q, k, v, each, c.heads // c.kv_heads, slots, c.rope_base, c.mask_mode, tile)
    out = [name("self_attn.o_proj")]
    x = cut(product(mixed, out, plain(out, biases), residual=x))
    gate, up = name("mlp.gate_proj"), name("mlp.up_proj")
    hidden = product(x, [gate, up], gated(gate, up, biases), second, c.eps)
    out = [name("mlp.down_proj")]
    return product(hidden, out, plain(out, biases), residual=x)

"""Sequence operators on tables of vectors: attention and triples.

A sequence is a group of rows (seq) in the order of a position.  A short one is
a task's, which takes it in blocks of queries and keys, so memory grows with
its length, not the square.  A long one is spread: each task takes a block of
its queries and a chunk of its keys and gives a maximum, a sum and a weighted
vector for each query, and these merge.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import kernels


#: A sequence of more rows is spread over tasks: so many queries and so many keys to a task.  Partial results that are merged together.
SPREAD_FROM, QUERY_BLOCK, KEY_CHUNK, MERGED = 4096, 1024, 4096, 64
#: A task's share of a sequence: so many blocks that there are PANELS along a side, of PANEL_ROWS rows at most; queries that it takes at once.
PANELS, PANEL_ROWS, AT_ONCE = 8, 16_384, 512
_OUT = pa.schema([("seq", pa.int64()), ("pos", pa.int64()), ("head", pa.int32()), ("out", pa.list_(pa.float64()))])
_OUT_SQL = "seq long, pos long, head int, out array<double>"


def _vectors(table: pa.Table) -> np.ndarray:
    return table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _outputs(seq: int, pos: np.ndarray, out: np.ndarray) -> pa.Table:
    """Rows of (heads, positions, numbers)."""
    heads, n, each = out.shape
    flat = pa.ListArray.from_arrays(pa.array(np.arange(heads * n + 1, dtype=np.int32) * each), np.ascontiguousarray(out).reshape(-1))
    return pa.table([pa.array(np.full(heads * n, seq)), pa.array(np.tile(pos, heads)), pa.array(np.repeat(np.arange(heads, dtype=np.int32), n)), flat], schema=_OUT)


def attention(rows: DataFrame, heads: int, kv_heads: int | None = None, mask_mode: str = "causal", spread_from: int = SPREAD_FROM, query_block: int = QUERY_BLOCK, key_chunk: int = KEY_CHUNK) -> DataFrame:
    """seq, pos, head, out array<double>: self-attention of rows (seq, pos, vec), the vector split into heads.

    pos counts a sequence's rows from 0.  kv_heads: keys and values have the
    first so many heads only, each shared by a group of query heads.
    mask_mode: causal, none, or additive (1 is added on and below the diagonal
    and nothing is masked).  Sequences of up to `spread_from` rows are a task's
    each; longer ones are spread.
    """
    kv = kv_heads or heads

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        x = _vectors(table).reshape(table.num_rows, heads, -1).transpose(1, 0, 2)
        return _outputs(table["seq"][0].as_py(), table["pos"].to_numpy(), kernels.attention_in_blocks(x, x[:kv], x[:kv], mask_mode))

    shaped = rows.select(F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<double>").alias("vec"))
    long = shaped.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last")).filter(F.col("n") > spread_from)
    if long.isEmpty():
        return shaped.groupBy("seq").applyInArrow(run, _OUT_SQL)
    long = cut(long)
    short = shaped.join(long, "seq", "left_anti").groupBy("seq").applyInArrow(run, _OUT_SQL)
    return short.unionByName(_spread(shaped.join(long, "seq"), heads, kv, mask_mode, query_block, key_chunk))


def _panels(rows: DataFrame, causal: bool, query_block: int, key_chunk: int) -> tuple[DataFrame, DataFrame]:
    """Queries and keys (seq, qb, kc, pos, vec) of rows (seq, pos, vec, last), once for each two panels that meet.

    A panel is some blocks of queries, or chunks of keys.  They grow with the
    sequence, so rows are sent PANELS times, not once for each block, until a
    panel has what a task should hold.
    """
    wide = lambda unit: F.greatest(F.least(F.ceil((F.col("last") + 1) / (PANELS * unit)), F.lit(PANEL_ROWS // unit)), F.lit(1)) * unit
    query_block, key_chunk = wide(query_block), wide(key_chunk)
    block, chunk = F.floor(F.col("pos") / query_block).cast("int"), F.floor(F.col("pos") / key_chunk).cast("int")
    last_block, last_chunk = F.floor(F.col("last") / query_block).cast("int"), F.floor(F.col("last") / key_chunk).cast("int")
    # the last chunk that a block of queries sees, and the first block of queries that sees a chunk
    upto = F.floor(((block + 1) * query_block - 1) / key_chunk).cast("int") if causal else last_chunk
    since = F.floor(chunk * key_chunk / query_block).cast("int") if causal else F.lit(0)
    queries = rows.select("seq", "pos", "vec", block.alias("qb"), F.explode(F.sequence(F.lit(0), F.least(upto, last_chunk))).alias("kc"))
    keys = rows.select("seq", "pos", "vec", chunk.alias("kc"), F.explode(F.sequence(since, last_block)).alias("qb"))
    keys = keys.toDF(*keys.columns)  # columns of their own, as both sides come from one frame
    return queries, keys


def _spread(rows: DataFrame, heads: int, kv: int, mask_mode: str, query_block: int, key_chunk: int) -> DataFrame:
    """attention() of rows (seq, pos, vec, last): softmax in parts, one for each panel of queries and panel of keys, that merge by their maxima and sums."""
    queries, keys = _panels(rows, mask_mode == "causal", query_block, key_chunk)

    def part(q: pa.Table, k: pa.Table) -> pa.Table:
        if not q.num_rows or not k.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(_PART.names, _PART.types)})
        q, k = q.sort_by("pos"), k.sort_by("pos")
        x, y = (_vectors(t).reshape(t.num_rows, heads, -1).transpose(1, 0, 2) for t in (q, k))
        at, of = q["pos"].to_numpy(), k["pos"].to_numpy()
        found = [kernels.attention_part(x[:, i : i + AT_ONCE], y[:kv], y[:kv], at[i : i + AT_ONCE], of, mask_mode) for i in range(0, len(at), AT_ONCE)]
        top, total, mixed = (np.concatenate(a, axis=1) for a in zip(*found))
        return pa.table([q["seq"].slice(0, 1), q["qb"].slice(0, 1), k["kc"].slice(0, 1), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (q["pos"].to_numpy(), top, total, mixed))], schema=_PART)

    def merged(table: pa.Table):
        """(positions, maxima, sums, vectors) of a block's parts, in the order of their chunks."""
        parts = table.sort_by("kc").to_pylist()
        pos = np.frombuffer(parts[0]["pos"], np.int64)
        found = [[np.frombuffer(p[n], np.float64).reshape(heads, len(pos), -1) for n in ("top", "total", "mixed")] for p in parts]
        return pos, *functools.reduce(kernels.merge_parts, found)

    def some(table: pa.Table) -> pa.Table:
        arrays = merged(table)
        return pa.table([*(table[c].slice(0, 1) for c in ("seq", "qb", "kc")), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays)], schema=_PART)

    def all_of_it(table: pa.Table) -> pa.Table:
        pos, _, total, mixed = merged(table)
        return _outputs(table["seq"][0].as_py(), pos, mixed / total)

    parts = queries.groupBy("seq", "qb", "kc").cogroup(keys.groupBy("seq", "qb", "kc")).applyInArrow(part, _PART_SQL)
    some_of_it = parts.withColumn("of", F.floor(F.col("kc") / MERGED)).groupBy("seq", "qb", "of").applyInArrow(lambda t: some(t.drop_columns("of")), _PART_SQL)
    return some_of_it.groupBy("seq", "qb").applyInArrow(all_of_it, _OUT_SQL)


_PART = pa.schema([("seq", pa.int64()), ("qb", pa.int32()), ("kc", pa.int32()), ("pos", pa.binary()), ("top", pa.binary()), ("total", pa.binary()), ("mixed", pa.binary())])
_PART_SQL = "seq long, qb int, kc int, pos binary, top binary, total binary, mixed binary"


def box_mask(boxes: DataFrame, side: int = 16, width: int = 800, height: int = 600) -> DataFrame:
    """image_id, box_id, patch: the patches of a side x side grid, at k / (side - 1) of the image, that lie in the box, borders included.

    The patches follow from the corners by arithmetic, so nothing is joined.
    """
    n = side - 1
    low = lambda c, size: F.ceil(n * F.col(c) / F.lit(float(size))).cast("long")
    high = lambda c, size: F.floor(n * F.col(c) / F.lit(float(size))).cast("long")
    x = boxes.select("image_id", "box_id", low("x1", width).alias("c0"), F.least(high("x2", width), F.lit(n)).alias("c1"), low("y1", height).alias("r0"), F.least(high("y2", height), F.lit(n)).alias("r1"))
    x = x.filter("c0 <= c1 AND r0 <= r1").withColumn("r", F.explode(F.sequence("r0", "r1"))).withColumn("c", F.explode(F.sequence("c0", "c1")))
    return x.select("image_id", "box_id", (F.col("r") * side + F.col("c")).alias("patch"))


def triples(boxes: DataFrame, wholes: DataFrame, texts: DataFrame) -> DataFrame:
    """image_id, box_idx, slot (0 box, 1 global, 2 text), vec: of boxes (image_id, box_idx, vec), wholes and texts (image_id, vec)."""
    g = wholes.select("image_id", F.col("vec").alias("g"))
    t = texts.select("image_id", F.col("vec").alias("t"))
    x = boxes.join(g, "image_id").join(t, "image_id")
    return x.select("image_id", "box_idx", F.posexplode(F.array("vec", "g", "t")).alias("slot", "vec"))

r"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its terms are the places of its components, its
weights floor(1024 * x).  Rows are dealt into blocks; a block turns into
postings (for each term the rows that hold it and their weights).  A query row
scatters its weighted postings, term after term, into a dense array of the
block's scores; a partition selection keeps the k best of the block, and the
blocks' winners are merged by query.

Queries come in blocks too, so a task holds one block of rows and one of
queries, whatever their numbers: nothing is broadcast or collected.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without vec_id, take no part; an empty vector scores 0; vectors of unlike
length meet on the terms that both have; rows with the query's vec_id are its
own, repeated query rows count once and repeated candidates each count; scores
beyond the range of long stop at its ends; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, finite

SCALE = 1024
K = 10
#: Rows of a block, queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
_LIMIT = 2**63


def _weights(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components; weights are exact integers (as objects where 64 bits might not do)."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = array.flatten(), np.diff(array.offsets.to_numpy())
    plain = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        values = np.floor(SCALE * plain)  # exact, but where it overflows
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, term = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - starts
    if len(values) and np.abs(values).max() >= 2.0**31:
        return row, term, np.array([int(v) if np.isfinite(v) else SCALE * int(x) for v, x in zip(values, plain)], dtype=object)
    return row, term, values.astype(np.int64)


def postings(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights), without zero weights."""
    keep = weight != 0
    row, term, weight = row[keep], term[keep], weight[keep]
    order = np.argsort(term, kind="stable")
    terms, first = np.unique(term[order], return_index=True)
    cuts = np.append(first, len(order))
    return {int(t): (row[order[a:b]], weight[order[a:b]]) for t, a, b in zip(terms, cuts, cuts[1:])}


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        found = np.flatnonzero(scores >= least)
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found]))[:k]] if scores.dtype != object else np.array(sorted(found, key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            ids = rows["vec_id"].to_numpy()
            r, t, w = _weights(rows["embedding"])
            lists = postings(r, t, w)
            qr, qt, qw = _weights(queries["embedding"])
            big = max((abs(int(x)) for x in (w.max(initial=0), w.min(initial=0))), default=0) * max((abs(int(x)) for x in (qw.max(initial=0), qw.min(initial=0))), default=0) * max(1, len(lists))
            exact = object if big >= _LIMIT or w.dtype == object or qw.dtype == object else np.int64
            ends = np.searchsorted(qr, np.arange(queries.num_rows + 1))
            for i, q in enumerate(queries["vec_id"].to_numpy()):
                scores = np.zeros(len(ids), dtype=exact)
                for j in range(ends[i], ends[i + 1]):
                    if (hit := lists.get(int(qt[j]))) is not None and qw[j]:
                        scores[hit[0]] += hit[1] * qw[j]
                others = np.flatnonzero(ids != q)
                top = others[best(scores[others], ids[others], k)]
                out[0].extend([q] * len(top))
                out[1].extend(ids[top])
                out[2].extend(min(max(int(s), -_LIMIT), _LIMIT - 1) for s in scores[top])
        return pa.table([pa.array(x, c.type) for x, c in zip(out, schema)], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score over vectors (vec_id, embedding), for the rows where is_query holds."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = rows.filter(is_query).dropDuplicates()
    counts = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    n_rows, n_queries = blocks(counts[0], block_rows), blocks(counts[1], block_queries)
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", deal(n_rows, 1)).withColumn("qb", every(n_queries))
    right = queries.withColumn("qb", deal(n_queries, 2)).withColumn("rb", every(n_rows))
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS x) u WHERE x IS NULL OR NOT isfinite(x))),
c AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS j,
         unnest(embedding) AS x FROM v),
w AS (SELECT vec_id, j, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM c),
p AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(SUM(q.w * r.w) AS BIGINT) AS score
  FROM w q JOIN w r ON q.j = r.j AND q.vec_id <> r.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10
"""

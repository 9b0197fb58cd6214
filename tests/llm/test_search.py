import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, topk

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], SCHEMA)


def some(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.standard_normal((n, dim)))]


ODD = [(1000, None), (1001, [1.0, None]), (1002, [NAN] * 8), (1003, [INF] * 8), (None, [1.0] * 8)]


def brute_topk(rows, every, k):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 2048), (7, 3)])
def test_topk(spark, blocks):
    rows = some(60) + ODD + [(5000, [0.5] * 8), (5000, [0.5] * 8), (60, []), (65, [1.0, 2.0]), (70, [0.0] * 8)] + [(100 + k, [0.25] * 8) for k in range(30)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, 10, *blocks)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(rows, 5, 10)


def test_topk_few_and_large(spark):
    rows = [(0, [1e12, -1e12]), (1, [1e12, 1e12]), (2, [3.0, 1.0])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows), F.col("vec_id") == 2).collect()}
    assert got[2, 1] == (1, sum(int(np.floor(1024 * float(np.float32(1e12)))) * y for y in (3072, 1024))) and len(got) == 2
    huge = topk.top_k(vectors(spark, [(0, [3e38]), (1, [3e38])]), F.lit(True)).collect()
    assert {r.score for r in huge} == {2**63 - 1}
    assert topk.top_k(vectors(spark, []), F.lit(True)).count() == 0
    assert topk.top_k(vectors(spark, [(1, [1.0])]), F.lit(True)).count() == 0


def test_postings_scatter():
    lists = topk.postings(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([3, 0, -2]))
    assert {t: (r.tolist(), w.tolist()) for t, (r, w) in lists.items()} == {0: ([0], [3]), 1: ([1], [-2])}


def brute_nearest(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            found = sorted((-round(float(a @ v / np.sqrt(a @ a) / np.sqrt(v @ v)), 12), i) for i, v in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_ann_is_exact_on_few_rows(spark):
    rows = some(300) + ODD + [(2000, [0.0] * 8), (2001, [1.0] * 5)] + [(3000 + k, [0.5, -0.5] * 4) for k in range(40)]
    got = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    assert got == brute_nearest(rows, 50, 5)
    assert ann.nearest(vectors(spark, []), F.lit(True)).count() == 0
    assert ann.nearest(vectors(spark, [(1, [1.0, 0.0])]), F.lit(True)).count() == 0


def test_ann_takes_every_length_by_itself(spark):
    rows = some(60) + [(1000 + i, v) for i, v in some(40, dim=3, seed=9)] + [(5000, [2.0])]
    got = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 1000, 1020} and all(len(v) == 3 for v in got.values())
    assert all((i < 1000) == (q < 1000) for q, found in got.items() for i in found)


def test_ann_of_many_lengths_is_one_plan(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(2 + i % 60 if i % 3 else 8).tolist()) for i in range(900)] + [(50, rng.standard_normal(7).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = ann.nearest(frame, F.col("vec_id") % 50 == 0, shard_rows=7)
    plan = made._jdf.queryExecution().toString()
    assert plan.count("FlatMapCoGroupsInArrow") <= 5 * (ann.INDEXED + 1)
    got = {}
    for r in made.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, x in rows:
        if q % 50 == 0 and q != 50:
            near = sorted((-float(ann.cosine(np.array([v]), np.array(x))[0]), i) for i, v in rows if i != q and len(v) == len(x))[:5]
            assert got.get(q, []) == [(k, i) for k, (_, i) in enumerate(near, 1)], q


def test_topk_beyond_doubles(spark):
    rows = [(0, [1.7e308, 1.0]), (1, [1e306, -1e306]), (2, [-1.7e308, 0.5]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(x) * 1024 if abs(x) > 1e300 else int(np.floor(x * 1024)) for x in v] for i, v in rows}
    for r in topk.top_k(df, F.lit(True)).collect():
        score = sum(a * b for a, b in zip(whole[r.query_id], whole[r.vec_id]))
        assert r.score == max(-(2**63), min(2**63 - 1, score))


def test_ann_recall(spark):
    rng = np.random.default_rng(5)
    near = rng.standard_normal(8)
    rows = some(4000, seed=3) + [(10_000 + k, (near + 0.01 * rng.standard_normal(8)).tolist()) for k in range(2000)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, 5, shard_rows=500).collect()
    want = brute_nearest([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 100, 5)
    truth = {(q, i) for q, found in want.items() for i, _ in found}
    assert len(got) == len(truth)
    assert len({(r.query_id, r.vec_id) for r in got} & truth) >= 0.9 * len(truth)


def test_walk_goes_by_rising_distance():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7))
    cells = ann.walk(a, b, counts, 10**9)
    assert sorted(cells) == np.flatnonzero(counts.ravel()).tolist()
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums)
    assert ann.walk(a, b, counts, 5) == cells[: len(ann.walk(a, b, counts, 5))]

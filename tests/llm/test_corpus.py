import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.llm import bpe, mixing, ngram_join, quality, secret_scan
from gridloom.llm import words as w

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was for on are with as be at by this that from it or an which we can all their has more if will".split()


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        x = [str(rng.choice(WORDS)) + str(rng.choice(["", "ing", "er", "ly", "tion"])) for _ in range(int(rng.integers(1, 150)))]
        bad = rng.random() < 0.25
        kind = rng.integers(0, 3)
        if bad:
            x = [f"{a}***" for a in x] if kind == 0 else [a.upper() + "!!" for a in x] if kind == 1 else [a for a in x for _ in range(8)]
        text = " ".join(x)
        docs.append((i, text, "en", f"src{i % 7}" if i % 3 else "src0", len(text)))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_classifier_learns(spark):
    docs, labels = corpus()
    labels += [(3, None, 0), (None, 1, 0), (5, labels[5][1], 0)]
    odd = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "x", "en", "s", 1), (9002, "word " * 30_000, "en", "s", 150_000)]
    d = spark.createDataFrame([(*r, "clash") for r in docs + odd], DOCS + ", label string").repartition(3)
    model = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    assert len(got) == len(docs) + 4 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None) and got[None].held_out
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    truth = {i: q for i, q, _ in labels if i is not None and q is not None}
    held = [r for i, r in got.items() if i in truth and r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    again = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)
    kept = quality.keep(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_classifier_without_labels(spark):
    d = spark.createDataFrame(corpus(20)[0], DOCS)
    for labels, score in (([], 0.5), ([(k, 1, 0) for k in range(20)], 1.0)):
        model = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert {r.score for r in quality.score(d, model).collect()} == {score}
    assert quality.score(d.limit(0), model).count() == 0


def test_passages_do_not_depend_on_the_batch():
    texts = [d[1] for d in corpus(40)[0]] + ["", None, "  ", "one"]

    def features(size):
        out = []
        for _, raw, ends in w.pieces(pa.array(texts), size):
            x, first = quality.passages(raw, ends)
            out += [x[a:b] for a, b in zip(first, first[1:])]
        return out

    for a, b in zip(features(1 << 20), features(1)):
        assert np.allclose(a, b)
    assert [len(f) for f in features(50)] == [max(1, -(-len((t or "").split()) // quality.PASSAGE)) for t in texts]


def test_long_texts_in_pieces_are_as_whole_ones():
    rng = np.random.default_rng(4)
    for text in ["  lead " + " ".join("".join(rng.choice(list("abé🙂,."), int(rng.integers(1, 9)))) for _ in range(3000)) + " \n ", "x" * 5000, " " * 4000, "word " * 2000, " y" * 31 + " " * 3000 + "z z"]:
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.array([0, len(raw)])
        whole, first = quality.passages(raw, ends)
        for long in (40, 500, 1999):
            pieces, again = quality.passages(raw, ends, long)
            assert np.allclose(pieces, whole) and first.tolist() == again.tolist()
        start, stop, _ = w.words(raw, ends)
        want = w.hashes(raw, start, stop)
        kept, w.PIECE = w.PIECE, 100
        try:
            assert (w.hashes(raw, start, stop) == want).all()
        finally:
            w.PIECE = kept


def test_gradients():
    rng = np.random.default_rng(0)
    model = quality.Model.untrained(rng)
    x, first, y = rng.standard_normal((9, quality.FEATURES)), np.array([0, 2, 5, 9]), np.array([0.0, 1.0, 1.0])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    grad = model.gradients(model.forward(x, first), first, y)

    def loss():
        s = model.forward(x, first)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name in grad:
        at = tuple(0 for _ in model.p[name].shape)
        kept, step = model.p[name][at], 1e-5
        model.p[name][at] = kept + step
        up = loss()
        model.p[name][at] = kept - step
        down = loss()
        model.p[name][at] = kept
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-4, name


def water_fill(sizes, weights, share=1.5, most=2.0):
    """By rounds, as the words say it: clamp, share the excess by weight, until none is above."""
    budget, open_, target = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    left = budget
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total >= most * sizes[k]]
        if not over:
            for k in open_:
                target[k] = left * weights[k] / total
            return target
        for k in over:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in over)
        open_ = [k for k in open_ if k not in over]
    return target


def test_water_filling(spark):
    rng = np.random.default_rng(0)
    for _ in range(6):
        n = int(rng.integers(1, 12))
        sizes = [int(x) for x in rng.choice([0, 1, 5, 100, 3000, 50_000], n)]
        names = sorted(f"s{k}" for k in range(n))
        rows = list(zip(names, sizes)) + [(None, 77)]
        got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        want = water_fill([*sizes, 77], [(5, 2, 1)[k % 3] for k in range(n + 1)])
        assert [got[s] for s, _ in rows] == pytest.approx(want)


def mix_rows():
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" for _ in range(int(rng.integers(0, 60)))), "en", ["a", "b", "é", "Z", None][int(rng.choice(5, p=[0.5, 0.2, 0.15, 0.1, 0.05]))], 0) for i in range(400)]
    return rows + [(7, rows[7][1], "en", rows[7][3], 0)] * 3 + [(None, "x y", "en", "a", 0), (None, None, None, "a", None), (900, "\x0bone\ttwo\x85three ", "en", "tiny", 0)]


def test_mix(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], DOCS + ", target int, place string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    totals = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        t = totals.setdefault(r.source, [0, 0, r.source_size, r.target])
        t[0] += r.taken
        t[1] += r.size
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill([totals[s][1] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    for s, target in zip(order, want):
        taken, size, source_size, own = totals[s]
        assert size == source_size and own == pytest.approx(target) and abs(taken - target) <= 5
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents(spark):
    docs = spark.createDataFrame(mix_rows(), DOCS)
    counts = {}
    for r in mixing.mix(docs.filter("doc_id IS NOT NULL AND doc_id <> 7")).collect():
        counts[r.doc_id] = r.taken if r.size else 0
    out = mixing.mixed_documents(docs.filter("doc_id IS NOT NULL AND doc_id <> 7")).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in counts.items() if v}


def test_mixing_is_native(spark):
    plan = mixing.mix(spark.createDataFrame(mix_rows(), DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(300)
    docs += [(1000 + k, docs[10][1] + " " + "copy" * (k + 1), "en", "src1", 1) for k in range(4)] if len(docs[10][1].split()) > 30 else []
    docs += [(2000, "some clean words and then password=b7db7aa4a5fcc78305 at the end of it", "en", "src2", 70), (2001, None, None, None, None), (2002, "", "en", "src3", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert k == 4 or out.columns == at.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        results.append((at, at := spark.read.parquet(str(tmp_path / f"out{k}"))))
    good = {i for i, q, _ in labels if q}
    kept = {r.doc_id for r in results[0][1].collect()}
    assert len(good - kept) <= 0.03 * len(good) and len(kept & {i for i, q, _ in labels if not q}) <= 10
    components = {r.doc_id: r.component_id for r in ngram_join.join(results[1][0]).collect()}
    assert sorted(r.doc_id for r in results[1][1].collect()) == sorted(set(components.values()))
    assert all(not secret_scan.spans(r.text) for r in results[2][1].collect())
    assert results[2][1].count() == results[2][0].count()
    run = sorted((r.doc_id, r.n_tokens, r.token_ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert run == sorted((r.doc_id, r.n_tokens, r.token_ids) for r in results[4][1].collect())
    assert all(n == len(ids) for _, n, ids in run) and any(n for _, n, _ in run)


def test_last_stage_decodes(spark):
    name, stage = corpus_pipeline.STAGES[-1]
    docs = spark.createDataFrame([(1, "Some words, and more.", "en", "a", 21), (2, None, "en", "a", 0)], DOCS)
    got = {r.doc_id: r for r in stage(spark, docs, "").collect()}
    assert name == "BPE encoding and decoding"
    assert got[1].decoded == bpe.codec().decode(got[1].token_ids) != "" and got[2].decoded == ""


def plain_features(text):
    """Features of each passage of a text, one word and one byte at a time."""
    raw = (text or "").encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out = []
    for k in range(max(1, -(-len(words) // quality.PASSAGE))):
        own = words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        begin = own[0][0] if k else 0
        end = words[(k + 1) * quality.PASSAGE][0] if (k + 1) * quality.PASSAGE < len(words) else len(raw)
        x = np.zeros(quality.FEATURES)
        for b in raw[begin:end]:
            x[quality._KIND[b]] += 1
        x[: quality.KINDS] = np.sqrt(x[: quality.KINDS] / max(1, end - begin))
        spelled = [raw[a:b] for a, b in own]
        n = max(1, len(own))
        bag = np.zeros(quality.BUCKETS)
        for s in spelled:
            bag[int(w.hashes(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0]) >> 58] += 1 / n
        again = [sum(a == b for a, b in zip(spelled, spelled[lag:])) / n for lag in (1, 2)]
        more = [*again, float((bag**2).sum()), sum(map(len, spelled)) / n / 16, len(own) / quality.PASSAGE, float(bag.max())]
        x[quality.KINDS : quality.KINDS + 6] = more
        x[quality.KINDS + 6 :] = np.sqrt(bag) / 4
        out.append(x)
    return out


def plain_score(p, text):
    """The score by the formulas of gated attention, passage by passage."""
    hidden, weights = [], []
    for x in plain_features(text):
        h = np.tanh(((x - p["mean"]) * p["scale"]) @ p["W"] + p["b"])
        gate = 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        hidden.append(h)
        weights.append(float(np.exp((np.tanh(h @ p["V"] + p["v"]) * gate) @ p["a"])))
    bag = sum(h * a for h, a in zip(hidden, weights)) / sum(weights)
    return 1 / (1 + np.exp(-np.clip(bag @ p["z"] + p["c"][0], -30, 30)))


def test_scores_against_the_plain_formulas(spark):
    docs, labels = corpus(200)
    texts = [t for _, t, *_ in docs[:60]] + [None, "", "   ", "\n", "one", "é ñ  日本 " * 50, "word " * 700, " lead and  tail\t", "x" * 3000]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    model = quality.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(model.p, t), abs=2e-4), t


def test_all_passages_are_learnt_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.extend(len(b) for b in bags))
    docs = spark.createDataFrame([(1, "word " * 6400, "en", "a", 0), (3, "word " * 33, "en", "a", 0)], DOCS)
    quality.train(docs, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"))
    held = [i for i in (1, 3) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(seen) == sorted(n for i, n in ((1, 200), (3, 2)) if i not in held)


def test_levels_of_buckets_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(mix_rows(), DOCS)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, r.source or "")
    want = sorted(map(key, mixing.mix(docs).collect()))
    for per_bucket, digits in ((20, 1), (1, 1), (5, 3)):
        monkeypatch.setattr(mixing, "PER_BUCKET", per_bucket)
        monkeypatch.setattr(mixing, "DIGITS", digits)
        assert sorted(map(key, mixing.mix(docs).collect())) == want


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"w{k}" for k in range(30_000))
    texts = [None, "", "   ", "one", "two words", long, long + " more", "x" * 100_000, "secret=abcdefghijkl0123 and more words follow here", "é🙂 日本 text"] + ["same words in this text every time here"] * 4
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else 0, "a", 1.5, i) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id at all here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names with dots and spaces, and those that the operators use for themselves, come through with their values."""
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["a.b", "__size", "__take", "__gone", "__again", "__copies", "__part", "__whole", "__source", "component", "other7", "s", "a b", "x`y", "place", "size", "id", "node"]
    rows = [(*r[:5], *(f"{r[0]}/{n}" for n in names)) for r in odd_rows()]
    schema = StructType([*spark.createDataFrame([], ODD_DOCS).schema.fields[:5], *(StructField(n, StringType()) for n in names)])
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names
        for r in out.collect():
            assert list(r)[5:] == [f"{r[0]}/{n}" for n in names]


def test_of_rows_with_one_id_the_same_one_stays(spark):
    rows = [(i % 4, f"text number {k} is here", "en", "a", k) for k, i in enumerate(range(40))]
    kept = {tuple(sorted(tuple(r) for r in ngram_join.one_of_each(spark.createDataFrame(rows, DOCS).repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(kept) == 1 and len(next(iter(kept))) == 4


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, score double, size long"


def test_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    every = spark.createDataFrame(odd_rows(), ODD_DOCS).repartition(3)
    for docs in (every, every.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == 4 or out.columns == docs.columns
            rows = out.collect()
            assert len(rows) <= 2 * docs.count() and (rows or docs is not every)
    near = corpus_pipeline.near_duplicates_stage(spark, every, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10] and sum(r.doc_id is None for r in near) == 2
    hidden = corpus_pipeline.secrets_stage(spark, every, str(tmp_path)).collect()
    assert len(hidden) == len(odd_rows()) and [r.text for r in hidden if r.doc_id == 8] == ["[secret] and more words follow here"]
    mixed = corpus_pipeline.mixing_stage(spark, every, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} >= {0, 1, 2, None}

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import chunk_dedup, graph, ngram_join
from gridloom.llm import words as w


def shingle_set(text):
    x = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(x[k : k + 5]) for k in range(len(x) - 4)) if len(x) >= 5 else frozenset([tuple(x)] if x else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i if i is not None else -1, len(s), root(i) if i is not None and s else i if i is not None else -1) for i, s in sets)


def corpus(seed, n=120, copies=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    line = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = []
    for _ in range(n):
        body = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 9, 14, 30, 60, 200])))
        texts.append(f"{line} {body}" if rng.random() < 0.4 else body)
    hot = " ".join(rng.choice(vocabulary) for _ in range(80)).split()
    for _ in range(copies):  # near copies of one text: some link, some only through others
        x = list(hot)
        for _ in range(rng.randint(0, 5)):
            x[rng.randrange(len(x))] = rng.choice(vocabulary)
        texts.append(" ".join(x))
    for _ in range(60):
        x = rng.choice(texts[:n]).split()
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = "NEW"
        texts.append("\n".join(x).upper() if rng.random() < 0.5 else "  ".join(x))
    rng.shuffle(texts)
    return list(enumerate(texts))


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "é\x0bß x y z q"), (906, "É\x0bß x y z q"), (None, "one two"), (907, "a b c d e f g"), (907, "other words here and some more of them"), (908, "other words here and some more of them")]


@pytest.mark.parametrize("seed", range(2))
def test_join(spark, seed, monkeypatch):
    rows = corpus(seed) + ODD
    if seed:  # long lists and several parts, as a large corpus has them
        monkeypatch.setattr(ngram_join, "LONG", 3)
        monkeypatch.setattr(ngram_join, "TOGETHER", 5)
        monkeypatch.setattr(ngram_join, "CLASS_LEAST", 2)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, component_id string, node string, n int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in ngram_join.join(docs).collect())
    assert got == brute_components(rows)
    assert sum(a != c for a, _, c in got) > 40


def test_one_of_each(spark):
    rows = [(1, "a b c d e f", "s"), (2, "A b c d e f", "s"), (3, "x", None), (3, "x", None), (4, None, "s"), (None, "a b c d e f", "n")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(str(tuple(r)) for r in kept) == sorted(map(str, [(1, "a b c d e f", "s"), (3, "x", None), (4, None, "s"), (None, "a b c d e f", "n")]))


def test_join_empty(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = ngram_join.join(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 1), (2, 0, 2)]


def test_pigeonhole_holds_for_every_pair():
    """For sets that link, the smaller one's looks always meet the larger one's entries, whatever is allocated."""
    rng = np.random.default_rng(0)
    least = ngram_join.bands(4000)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        a = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        most = n // 4
        drop = int(rng.integers(0, most // 2 + 1))
        b = np.sort(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, most - drop + 1)) // 2, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        (sx, _), (sy, _) = (ngram_join.entries(s, np.zeros(len(s), int), np.array([len(s)]), least) for s in (small, large))
        looks = {int(x) >> 4 for x in sx if x & ngram_join._LOOKS}
        met = [x for x in sy if int(x) >> 4 in looks]
        spare = int(ngram_join._spare(small, np.zeros(len(small), int), np.array([len(small)]))[0])
        assert len(met) > spare or spare < 0 or len(met) >= 1


def test_words_and_hashes():
    texts = ["Ab cd\tab", None, "", "  x ", "ab"]
    found = {}
    for first, raw, ends in w.pieces(pa.array(texts), size=4):
        start, stop, text = w.words(raw, ends)
        for s, e, t, h in zip(start, stop, text, w.hashes(raw, start, stop)):
            found.setdefault(first + int(t), []).append((raw[s:e].tobytes(), int(h)))
    assert [[x for x, _ in found.get(k, [])] for k in range(5)] == [[b"Ab", b"cd", b"ab"], [], [], [b"x"], [b"ab"]]
    assert found[0][2][1] == found[4][0][1] != found[0][0][1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randint(2000, 2060), rng.randint(2000, 2060)) for _ in range(40)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in up if root(x) != x}


# chunks


def test_chunks_resist_shifts():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate([raw[:5000], np.frombuffer(b"inserted", np.uint8), raw[5000:]])
    chunks = []
    for r in (raw, moved):
        c = chunk_dedup.chunks(np.array([1]), r, np.array([0, len(r)]))
        assert c["size"].sum() == len(r) and (c["size"] <= chunk_dedup.MAX).all()
        chunks.append(set(zip(c["hi"].tolist(), c["lo"].tolist())))
    assert len(chunks[0] - chunks[1]) <= 6


def test_rolling_is_the_gear_hash():
    raw = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    ends = np.array([0, 0, 3, 40, 41, 60, 60, 300])
    out = []
    for a, b in zip(ends, ends[1:]):
        h = 0
        for x in raw[a:b]:
            h = ((h << 1) + int(chunk_dedup._GEAR[x])) & 0xFFFF
            out.append(h)
    assert chunk_dedup.rolling(raw, ends).tolist() == out


def test_cuts_keep_code_points():
    raw = np.frombuffer(("é🙂" * 400).encode(), np.uint8)
    ends = chunk_dedup.cuts(raw, np.array([0, len(raw)]))
    for a, b in zip([0, *ends], ends):
        raw[a:b].tobytes().decode()
    assert ends[-1] == len(raw)


def test_repeated_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line, other = text(60), text(9), text(70)
    rows = [(k, f"{text(40)} {passage} {text(30)}") for k in range(10)]
    rows += [(20 + k, f"{line}\n{text(50 + k)}\n{line}") for k in range(10)]  # clean, but for a common line
    rows += [(40, f"{other} {text(5)} {other}"), (41, None), (42, ""), (None, passage), (43, text(300))]  # repeats inside one document
    rows += [(50, "é " + other.replace("a", "ä")), (51, "x " + other.replace("a", "ä") + " 🙂"), (52, text(80)), (52, text(80))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, first string, words int")
    got = {r.doc_id: r for r in chunk_dedup.report(docs).collect()}
    assert set(got) == {*range(10), 50, 51}
    by_id = dict(rows)
    for i, r in got.items():
        a, b = map(int, r.spans.split(":"))
        assert r.n_passages == 1 and len(by_id[i][a:b].split()) >= 40 and by_id[i][a + 20 : b - 20] in (passage + other.replace("a", "ä"))
    assert [got[k].n_later for k in range(10)] == [0] + [1] * 9
    left = {r.doc_id: r.text for r in chunk_dedup.deduplicated(docs.filter("doc_id <> 52")).collect()}
    assert left[0] == by_id[0] and len(left[5]) < len(by_id[5]) - 200 and left[20] == by_id[20]
    assert chunk_dedup.report(docs.limit(0)).count() == 0


def test_gaps_never_pass_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.choice([50, 300, 2000, 5000, 9000]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, n // 4)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 4)), dtype=np.uint64)]))
        size = np.array([len(a), len(b)])
        made = ngram_join.sketches(np.concatenate([a, b]), np.repeat([0, 1], size), size)
        assert [8 * len(x) for x in made] == ngram_join.n_bits(size).tolist()
        x, y = ngram_join.folded(made, min(map(len, made)))
        gap, different = int(ngram_join.gaps(x, y)), len(np.setxor1d(a, b))
        assert 0.8 * different - 10 <= gap <= different and (gap - different) % 2 == 0
    assert ngram_join.n_bits(np.array([0, 1, 128, 129, 1000])).tolist() == [512, 512, 512, 1024, 4096]


def test_substring_keeps_one_copy_beside_boilerplate(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line, licence, body, ahead = prose(12), prose(80), prose(150), prose(90)
    copy = f"{ahead} {line} {body} {licence}"
    rows = [(0, f"{prose(60)} {line} {prose(60)} {licence}"), (2, copy), (3, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in chunk_dedup.deduplicated(docs).collect()}
    assert left[0] == rows[0][1]
    assert body in left[2] and ahead in left[2] and line in left[2]  # the least copy keeps what is first there, and a short line
    assert len(left[2].split()) < len(copy.split()) - 60  # but not the licence
    assert len(left[3]) < 100
    got = {r.doc_id: r for r in chunk_dedup.report(docs).collect()}
    assert (got[2].n_passages, got[2].n_later, got[3].n_passages, got[3].n_later) == (1, 1, 1, 1)
    assert got[2].spans == got[3].spans and got[0].n_later == 0


def test_repeated_passages_against_brute_force(spark):
    """Every document that shares 50 words in a row with another is found; found ones share 20 at least."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(4000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passages, lines = [prose(rng.randint(52, 120)) for _ in range(25)], [prose(rng.randint(4, 12)) for _ in range(6)]
    texts = []
    for k in range(400):
        body = prose(rng.randint(1, 400))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(passages) if rng.random() < 0.6 else rng.choice(lines)
        texts.append(" ".join(body))
    texts += [texts[7], texts[7], texts[8] + " more", None, "", "é🙂 " + texts[9]]
    size = 50

    def shared(size):
        holders = {}
        for i, t in enumerate(texts):
            x = (t or "").split()
            for k in range(len(x) - size + 1):
                holders.setdefault(tuple(x[k : k + size]), set()).add(i)
        return {i for h in holders.values() if len(h) > 1 for i in h}

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    found = {r.doc_id for r in chunk_dedup.report(docs).collect()}
    assert len(shared(size)) > 100 and shared(size) <= found <= shared(20)


def test_packing_changes_nothing(spark, monkeypatch):
    """What a batch knows to be repeated, and the documents that repeat themselves, come out as without any packing."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(500)]
    line = " ".join(rng.choices(words, k=40))
    rows = [(rng.randint(-(2**62), 2**62), " ".join([line] * rng.randint(0, 4) + rng.choices(words, k=rng.randint(1, 90)) + [line] * rng.randint(0, 2))) for _ in range(80)]
    rows += [(rows[3][0], rows[4][1]), (rows[5][0], rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for pack, parts in ((1_000_000, 1), (1, 9), (300, 3)):
        monkeypatch.setattr(chunk_dedup, "PACK", pack)
        got = sorted(tuple(r) for r in chunk_dedup.repeated_chunks(docs.repartition(parts)).collect())
        assert got and want in (None, got)
        want = got
    by_chunk, texts = {}, {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for i, a, b, _, later in want:
        if len(texts[i]) == 1:
            by_chunk.setdefault(texts[i][0][a:b], []).append((i, later))
    twice = [t for i, own in texts.items() if len(own) > 1 for t in own]
    for chunk, held in by_chunk.items():
        least = min(i for i, _ in held)
        if not any(chunk in t for t in twice):
            assert all(later == (i > least) for i, later in held)

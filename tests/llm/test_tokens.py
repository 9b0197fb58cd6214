"""Packing and alignment against the tokenizers' own libraries and plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import align, packing
from gridloom.llm.bpe import byte_symbols, path
from gridloom.llm.byte_bpe import byte_bpe, little
from gridloom.llm.common import table

SF = "/root/testdata/sf0.001"
BITS = ["a", " ", "  ", "\n", " \n", "foo", "<s>", "<|endoftext|>", "▁", "é", "é", "日本", "\x00", "\x1c", "\xa0", "　", "'s", "'S", "12", "<0x41>", "!?", "​", "😀", "\t", "naïve ", "Über", "İ", "\x85", "</s>", "<unk>", "͸", "\U0001e900"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    plain, special = Tokenizer.from_file(path("byte_bpe_50k.json")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    return plain, special, sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


def test_ids_are_those_of_the_library(libraries):
    _, special, _ = libraries
    own = byte_bpe()
    points = random.Random(2).sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 5000)
    texts = odd_texts(5000, 1) + [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b" for c in points] + [t.decode() for t in own.tokens.values() if t.isascii()]
    for text, made in zip(texts, special.encode_batch(texts, add_special_tokens=False)):
        assert own.pack(text) == little(made.ids), text


# packing


def lengths(seed, n):
    rng = random.Random(seed)
    return Counter(min(64, max(1, int(rng.lognormvariate(2.5, 1)))) if rng.random() < 0.7 else rng.randint(1, 64) for _ in range(n))


@pytest.mark.parametrize("counts", [{}, {64: 3}, {1: 1}, {5: 7}, {10: 10**6 + 1, 64: 10, 30: 3}, {3: 10**9, 44: 5, 60: 10**8, 32: 7}, *[lengths(s, n) for s, n in enumerate((5, 60, 3000, 200_000))]])
def test_plan_holds_every_length_in_few_sequences(counts):
    made = packing.plan(counts, 64)
    held = Counter()
    for parts, times in made:
        assert sum(parts) <= 64 and times > 0
        held.update({x: k * times for x, k in Counter(parts).items()})
    assert held == Counter(counts)
    least = -(-sum(x * n for x, n in counts.items()) // 64)
    most = {1_000_001: 10 + 166_669}.get(counts.get(10), least * 1.02 + 2)  # of tens, six fit in 64
    assert least <= sum(times for _, times in made) <= most
    assert len(made) <= 64 * 8  # however many pieces


def test_exact_complements_use_single_lengths_pairs_and_triples():
    left = packing.Available({60: 2, 4: 1, 50: 1, 9: 1, 5: 1, 40: 1, 12: 2, 20: 1}, 64)
    made = packing.exact_complements(left, 64)
    assert sorted(tuple(sorted(p)) for p, _ in made) == [(4, 60), (5, 9, 50), (12, 12, 40)] and left.n[60] == left.n[20] == 1
    left = packing.Available({40: 1, 12: 2}, 64)
    assert packing.exact_complements(left, 64) == [((40, 12, 12), 1)]
    left = packing.Available({16: 9}, 64)  # a length with itself
    assert packing.exact_complements(left, 64) == [((16,) * 4, 2)] and left.n[16] == 1


def check_packing(rows, capacity, ids_of, end=2):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():  # without gaps
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, parts in by_doc.items():
        ids, parts = [*ids_of[doc_id], end], sorted(parts, key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // capacity)
        assert [r.start for r in parts] == [0, *[len(ids) - capacity * k for k in range(len(parts) - 1, 0, -1)]]
        for r in parts:
            own = ids[r.start : r.start + r.length]
            assert r.length == len(own) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
    return len(by_sequence)


@pytest.mark.parametrize("part", [packing.PART, 3])
def test_packing_against_the_library(spark, libraries, monkeypatch, part):
    monkeypatch.setattr(packing, "PART", part)
    _, special, _ = libraries
    docs = table(spark, SF, "documents")
    ids_of = {r.doc_id: special.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    rows = packing.pack(docs).collect()
    assert {r.doc_id for r in rows} == set(ids_of)
    n = check_packing(rows, packing.CAPACITY, ids_of)
    assert n <= -(-sum(len(x) + 1 for x in ids_of.values()) // packing.CAPACITY) * 1.02 + 1


def test_packing_of_odd_rows(spark):
    texts = [None, "", "a", "a " * 100, "x<|endoftext|>y", "same text", "same text", "word " * 3000]
    rows = [(k if k != 3 else None, t, "x", 7) for k, t in enumerate(texts)] + [(5, "same text", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id int")
    made = packing.pack(docs, 16, with_ids=True)
    got = made.collect()
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "token_ids", "sequence_id", "offset"]
    own = byte_bpe()
    total = sum(len(own.pack(t)) // 4 + 1 for _, t, *_ in rows)
    assert sum(r.length for r in got) == total and all(r.length == len(r.token_ids) for r in got)
    joined = {r.sequence_id: r for r in packing.sequences(made).collect()}
    assert all(len(s.token_ids) == sum(s.lengths) <= 16 for s in joined.values()) and sum(len(s.token_ids) for s in joined.values()) == total
    for r in got:
        assert joined[r.sequence_id].token_ids[r.offset : r.offset + r.length] == r.token_ids
    assert packing.pack(docs.limit(0)).collect() == []


# alignment


def plain(text, a, b):
    """(A ids, B ids, groups, links) of a text by walking along both."""
    if not text:
        return [], [], "", []
    value = {s: i for i, s in enumerate(byte_symbols())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], "", []
    stop = lambda tokens: [sum(map(len, tokens[: k + 1])) for k in range(len(tokens))]
    ends_a, ends_b = stop(bytes_a), stop(bytes_b)
    groups, last = [], 0
    for end in sorted({*ends_a} & {*ends_b}):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if last < e <= end) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
        last = end
    links = [(x, y) for x, e in zip(ids_a, ends_a) for y, g in zip(ids_b, ends_b) if e == g]
    return ids_a, ids_b, ";".join(groups), links


def check_alignment(rows, texts, a, b):
    """texts: (doc_id, text), each row once."""
    made = {k: plain(t, a, b) for k, t in texts}
    counts = Counter(pair for *_, links in made.values() for pair in links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    assert len(rows) == len(texts)
    for r in rows:
        ids_a, ids_b, groups, links = made[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(ids_a), len(ids_b), groups.count("|"), len(links))
        assert r.n_best == sum(counts[p] == best[p[1]] for p in links) and r.count_sum == sum(counts[p] for p in links)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_alignment_of_documents(spark, libraries):
    docs = table(spark, SF, "documents").where(F.length("text") < 3000)
    check_alignment(align.report(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], libraries[0], libraries[2])


@pytest.mark.parametrize("remember", [align.REMEMBER, 5])
def test_alignment_of_odd_texts(spark, libraries, monkeypatch, remember):
    monkeypatch.setattr(align, "REMEMBER", remember)
    texts = list(enumerate([None, "", " ", "  ", "\n", *odd_texts(3000, 4)]))
    own = align.aligner()
    for first in range(0, len(texts), 500):
        for (k, text), got in zip(texts[first : first + 500], own.texts([t for _, t in texts[first : first + 500]])):
            ids_a, ids_b, groups, links = plain(text, libraries[0], libraries[2])
            assert got[:3] == (len(ids_a), len(ids_b), groups.encode()), text
            assert len(got[3]) == 4 * len(links)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts[:300]], "doc_id long, text string, n int, links string")
    check_alignment(align.report(docs).collect(), texts[:300], libraries[0], libraries[2])
    assert align.report(docs.limit(0)).collect() == []
    null_id = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("some text here"))
    assert [(r.doc_id, r.n_groups > 0) for r in align.report(null_id).collect()] == [(None, True)]


def test_owner_arrays():
    import numpy as np

    a, b = align.owners(np.array([2, 3, 1])), align.owners(np.array([1, 4, 1]))
    assert a.tolist() == [0, 0, 1, 1, 1, 2] and b.tolist() == [0, 1, 1, 1, 1, 2]
    assert [x.tolist() for x in align.overlaps(a, b)] == [[0, 0, 1, 2], [0, 1, 1, 2]]
    assert align.cuts(a, b).tolist() == [4, 5]


def test_linked_ids_are_suffixes_and_best_ones_told(spark):
    docs = table(spark, SF, "documents")
    aligned = align.alignments(docs, with_groups=True)
    linked = align.linked_ids(align.pair_counts(aligned)).collect()
    own = align.aligner()
    most = defaultdict(int)
    for r in linked:
        x, y = own.bytes_a[r.a], own.b.tokens[r.b]
        assert x.endswith(y) or y.endswith(x)
        most[r.b] = max(most[r.b], r.n)
    assert all(r.best == (r.n == most[r.b]) for r in linked) and sum(r.n for r in linked) == aligned.agg(F.sum("n_groups")).first()[0]
    first = aligned.where(F.col("n_groups") > 1).first()
    assert hashlib.sha256(first.groups.encode()).hexdigest() == first.groups_sha256 and first.groups.count(";") == first.n_groups - 1

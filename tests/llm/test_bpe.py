import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.path())


OWN = bpe.codec()


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = OWN.pack(text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids == OWN.ids(text), repr(text)
    assert OWN.decode(packed) == OWN.decode(ids) == library.decode(ids, skip_special_tokens=False)


TEXTS = ["", " ", "Hello, THE world's end", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "\x1c a\x1db \x85\xa0c", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "é ́x", "日本語のテキスト", "🙂🙂 don't we'll I'M", "x" * 3000, "ﬁ ½ ² Ⅷ 123456", "añb" * 500, "aaaa's 'sss ''s", "\x00\x01", "ß ẞ", "\U00010d50 Ᲊ"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(library, text):
    same(library, text)


SPELLINGS = [f"<|{x}|>" for x in ("endoftext", "ENDOFTEXT", "EndOfText", "startoftext", "STARTOFTEXT", "StartOfText", "endoftext ", "endo\u0301ftext")]
AROUND = ["", "a", " ", "A ", "İ", "é", "e\u0301", "\u0301", "日", "<", "|>", "<|", "Σ", "'s", "\n", "\x1c"]


@pytest.mark.parametrize("token", SPELLINGS)
def test_special_tokens_in_every_spelling(library, token):
    for before in AROUND:
        for after in AROUND:
            same(library, before + token + after)
            same(library, before + token + after + token)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SPELLINGS + AROUND), st.text(max_size=5)), max_size=8))
def test_special_tokens_among_any_text(library, parts):
    same(library, "".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    same(library, text)


def test_long_and_short_merges_agree():
    rng = random.Random(1)
    for _ in range(200):
        fragment = "".join(rng.choice("etaoin shrdl".replace(" ", "")) for _ in range(rng.randint(2, 60)))
        parts = list(fragment)
        parts[-1] += bpe.END
        assert OWN.merge(fragment, True) == OWN.merge_long(parts)


def test_forced_boundaries_never_lie_in_a_token():
    cuts = OWN.cut("".join(OWN.symbol[b] for b in "naïveñandú—x".encode()))
    assert len(cuts) > 1
    for token in list(OWN.vocab)[:20000]:
        assert OWN.cut(token.removesuffix(bpe.END)) == [token.removesuffix(bpe.END)]


def test_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 2)
    same(library, "one two three one two three four five, one; two")


def test_frames(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello <|endoftext|> world", None), (3, "Hello <|endoftext|> world", None), (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect())
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i or 0, len(ids), hashlib.sha256(b"".join(struct.pack("<I", x) for x in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    kept, bpe.TOGETHER = bpe.TOGETHER, 1
    try:
        assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs.coalesce(1)).collect()) == sorted(want)
    finally:
        bpe.TOGETHER = kept
    encoded = bpe.encode(docs, ["doc_id"]).filter("doc_id = 3").first()
    assert OWN.decode(encoded.token_ids) == encoded.decoded
    assert bpe.digests(docs.limit(0)).count() == 0

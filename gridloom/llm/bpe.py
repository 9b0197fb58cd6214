r"""BPE encoding and decoding with forced-boundary splitting.

A vocabulary fixes which pairs of bytes ever stand side by side inside one of
its tokens.  Between two bytes that never do, no merge can happen, so a cut
there is certain: a word is split at all such places, each fragment is encoded
on its own (only the word's last fragment carries the end-of-word mark) and
the pieces are joined again.  Fragments and words recur, so both are encoded
once per worker and remembered, in tables of bounded size.

The vocabulary is a tokenizers JSON file of a BPE model over byte symbols with
an end-of-word suffix, lower case and white space dropped; its place is a
parameter, read on the executors.  White space never lies in a token, so a text
is cut there first.  Words with a code point from U+0300 on (where Unicode
versions differ, and composition begins) are normalised and cut by the
library's own tables; all others by rules that agree with them.

Defined cases: null and empty texts have no tokens and decode to ""; special
tokens' strings in a text, spelled as they are, become their ids, as the
library has it, while other spellings are plain text; texts are
encoded whole, however long; the result holds one row per row.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .memory import lean, text_batches

VOCABULARY = "word_bpe_49k.json"
#: Words, and fragments of either kind, that a worker remembers, at most.
REMEMBER, FRAGMENTS = 400_000, 200_000
#: Bytes of texts whose tokens are handed on together, about (a longer text goes by itself).
TOGETHER = 2 << 20
#: From here on words take the library's normalizer.
COMPOSED = "\u0300"
COMPOSED_FROM = re.compile("[\u0300-\U0010ffff]")
#: The pattern of the vocabulary's pre-tokenizer (a fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s+")
#: str.split() takes these for white space, the vocabulary doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
END = "</w>"


def path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The symbol of each byte: itself if it prints, else the next free code point from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, free = {b: chr(b) for b in prints}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class Words(dict):
    """word -> ids as little-endian 32-bit integers, made when first asked for."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = made = self.codec.word_ids(word)
        return made


class Codec:
    def __init__(self, file: str):
        self.file = file
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == END and not model["byte_fallback"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True)))
        self.tokens = np.full(max([*self.vocab.values(), *self.special.values()]) + 1, "", dtype=object)
        for t, i in (self.vocab | self.special).items():
            self.tokens[i] = t
        self.packed = {t: struct.pack("<I", i) for t, i in self.vocab.items()}
        self.symbol = dict(enumerate(byte_symbols()))
        bodies = [t.removesuffix(END) for t in self.vocab]
        self.joined = {pair for body in bodies for pair in zip(body, body[1:])}
        self.fragments: tuple[dict, dict] = ({}, {})
        self.words = Words(self)

    @functools.cached_property
    def library(self):
        """The library's tokenizer, for its tables of code points; few texts need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def forget(self) -> None:
        for known in (self.words, *self.fragments):
            known.clear()

    # words

    def pieces(self, word: str) -> list[str]:
        """Pre-tokens of a word without white space, as byte symbols."""
        if max(word) < COMPOSED:
            return [p.encode().decode("latin-1").translate(self.symbol) for p in PATTERN.findall(word.lower())]
        normal = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def word_ids(self, word: str) -> bytes:
        return b"".join([self.piece_ids(p) for p in self.pieces(word)])

    # fragments

    def cut(self, piece: str) -> list[str]:
        """The fragments of a piece between its forced boundaries."""
        joined = self.joined
        at = [k for k, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in joined]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)])] if at else [piece]

    def piece_ids(self, piece: str) -> bytes:
        out = b""
        fragments = self.cut(piece)
        for k, fragment in enumerate(fragments, 1):
            known = self.fragments[k == len(fragments)]
            ids = known.get(fragment)
            if ids is None:
                if len(known) >= FRAGMENTS:
                    known.clear()
                known[fragment] = ids = self.merge(fragment, k == len(fragments))
            out += ids
        return out

    def merge(self, fragment: str, ends: bool) -> bytes:
        """Merge the best-ranked pair, at all its places, until no pair has a rank."""
        parts = list(fragment)
        if ends:
            parts[-1] += END
        if len(parts) > 400:
            return self.merge_long(parts)
        rank, never = self.rank.get, 1 << 30
        ranks = [rank(p, never) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)  # the leftmost place; the next ones follow with the same rank
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), never)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), never)
        return b"".join([self.packed.get(p, b"") for p in parts])

    def merge_long(self, parts: list[str]) -> bytes:
        """The same with a heap of pairs and a linked list, for fragments of any length."""
        import heapq

        rank, n = self.rank, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        token: list[str | None] = list(parts)
        heap = [(r, k, p) for k, p in enumerate(zip(parts, parts[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if token[k] != pair[0] or j < 0 or token[j] != pair[1]:
                continue
            token[k], token[j] = pair[0] + pair[1], None
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := rank.get((token[a], token[b]))) is not None:
                    heapq.heappush(heap, (r, a, (token[a], token[b])))
        return b"".join([self.packed.get(p, b"") for p in token if p is not None])

    # texts

    def pack(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text:
            return self.pack_plain(text)
        out, at = [], 0  # special tokens are found in the text as it is, before any lowering
        for m in self.special_at.finditer(text):
            out += [self.pack_plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self.pack_plain(text[at:])])

    def pack_plain(self, text: str) -> bytes:
        """The same of a text in which no special token is looked for."""
        if not COMPOSED_FROM.search(text):
            text = text.lower()  # word by word it would be the same
        split = [w for w in SPACE.split(text) if w] if SEPARATORS.search(text) else text.split()
        words = self.words
        return b"".join([words[w] for w in split])

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.pack(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The tokens of ids (a sequence or packed), joined by spaces (the vocabulary file names no decoder)."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids, dtype=np.int64)
        return " ".join(self.tokens[ids].tolist())


_codecs: dict[str, Codec] = {}


def codec(file: str | None = None) -> Codec:
    file = file or path()
    if file not in _codecs:
        _codecs[file] = Codec(file)
    return _codecs[file]


def _per_batch(file: str | None, keep: list[str], fields: list[tuple[str, pa.DataType]], of):
    """Batches of the kept columns and what `of` makes of the codec and a text's packed ids for each field."""

    def run(batches):
        own = codec(file)
        for batch in batches:
            first, size, out = 0, 0, [[] for _ in fields]
            for k, scalar in enumerate(batch["text"], 1):
                text = scalar.as_py()
                for values, made in zip(out, of(own, own.pack(text))):
                    values.append(made)
                size += len(text or "")
                if size >= TOGETHER or k == batch.num_rows:
                    kept = (batch[c].slice(first, k - first) for c in keep)
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, (_, t) in zip(out, fields))], [*keep, *(n for n, _ in fields)])
                    first, size, out = k, 0, [[] for _ in fields]

    return lean(run, lambda: codec(file).forget())


def _schema(docs: DataFrame, keep: list[str]) -> str:
    kinds = dict(docs.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in keep)


def encode(docs: DataFrame, keep: list[str], file: str | None = None, decoded: bool = True) -> DataFrame:
    """The kept columns, n_tokens, token_ids array<int> and, if asked for, the decoded text of docs' column text."""
    fields = [("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), *([("decoded", pa.string())] if decoded else [])]

    def of(own: Codec, ids: bytes):
        return len(ids) // 4, np.frombuffer(ids, "<i4"), *((own.decode(ids),) if decoded else ())

    text_batches(docs.sparkSession)
    rows = docs.select(*keep, "text")
    return rows.mapInArrow(_per_batch(file, keep, fields, of), _schema(docs, keep) + ", n_tokens long, token_ids array<int>" + ", decoded string" * decoded)


def digests(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_per_batch(file, ["doc_id"], fields, lambda own, ids: (len(ids) // 4, sha(ids), sha(own.decode(ids).encode()))), _schema(docs, ["doc_id"]) + ", n_tokens long, ids_sha256 string, decoded_sha256 string")

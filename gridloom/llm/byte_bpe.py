r"""Byte-level BPE of whole texts, chunk by chunk.

A token never reaches over a space that follows a character other than white
space: white space ends every other pre-token, and only looks ahead.  So a text
is cut there; a chunk and the space before it have the same tokens wherever
they stand.  Chunks recur, and a worker remembers those of a bounded number.

The vocabulary is a tokenizers JSON file of a byte-level BPE model; its merges
give the ranks of tiktoken, which encodes the chunks not known yet.  The two
libraries agree on every code point and on every token (tests/llm/test_tokens.py
repeats the comparison on seeded texts).
"""

from __future__ import annotations

import array
import json
import re
import sys

from .bpe import byte_symbols
from .bpe import path as tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: A certain cut is before a space that follows a character other than white space (Python's white space includes Unicode's).
CUT = re.compile(r"(?<=\S) ")
#: The pattern of the vocabulary's pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker remembers, at most; longer ones than so many characters aren't remembered.
REMEMBER, LONGEST = 400_000, 64


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array.array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class Chunks(dict):
    """chunk -> packed ids of a space and the chunk."""

    def __init__(self, encode, remember: int = REMEMBER):
        super().__init__()
        self.encode, self.remember = encode, remember

    def __missing__(self, chunk: str) -> bytes:
        made = little(self.encode(" " + chunk))
        if len(chunk) <= LONGEST:
            if len(self) >= self.remember:
                self.clear()
            self[chunk] = made
        return made


class ByteBPE:
    """The tokenizer of a file: `encode` gives ids of plain text, `pack` packed ids of a text in which special tokens count."""

    def __init__(self, file: str):
        import tiktoken

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        assert model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not model["ignore_merges"] and spec["normalizer"] is None
        value = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(value[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [bytes(value[c] for c in (m if isinstance(m, str) else "".join(m)) if c != " ") for m in model["merges"]]
        assert [ranks[m] for m in merged] == list(range(256, 256 + len(merged)))  # a merge's rank is its token's id
        self.special = special
        self.tokens = {i: token for token, i in ranks.items()}
        self.own = tiktoken.Encoding(name=file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.own.encode_ordinary
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.chunks = Chunks(self.encode)

    def pack(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special_at is None or not self.special_at.search(text):
            return self.pack_plain(text)
        return b"".join(little([self.special[t]]) if k % 2 else self.pack_plain(t) for k, t in enumerate(self.special_at.split(text)))

    def pack_plain(self, text: str) -> bytes:
        first, *rest = CUT.split(text)
        known = self.chunks
        return b"".join([little(self.encode(first)), *[known[c] for c in rest]])


_known: dict[str, ByteBPE] = {}


def byte_bpe(file: str | None = None) -> ByteBPE:
    file = file or tokenizer_path(VOCABULARY)
    if file not in _known:
        _known[file] = ByteBPE(file)
    return _known[file]

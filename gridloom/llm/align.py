"""Alignment of two tokenizers by byte-owner arrays, and counts of the ids that they link.

A text (with a space before it) is encoded by a byte-level BPE vocabulary, A,
and by a sentencepiece model, B.  `np.repeat` of token numbers over the bytes
that they hold gives each byte its owner in A and in B.  Where the pair of
owners changes, a new overlap begins; where both change at once, both tokenizers
end a token, and the text is cut into groups.  The tokens that end together at
the end of a group are linked.

Neither tokenizer has a token that reaches over a space after a character other
than white space, so a text's chunks between such spaces are aligned on their
own, all new ones of a batch in one pass, and remembered; a text's groups are
those of its chunks one after another.  A chunk whose bytes a tokenizer doesn't
give back sends its whole text through both tokenizers undivided.

Of two linked tokens, one is a suffix of the other (both end at the same byte
and begin within their group), so the vocabularies alone say which pairs of ids
can ever be linked: some hundred thousand, however large the corpus.  Counts
are arrays over these pairs: summed per task, then over tasks, and their bound
is what lets them go to the driver and to every task.

Defined cases: null and empty texts, and those whose tokens' bytes differ from
the text's, have no tokens: zeros, and '' for groups and their digest; strings
of special tokens in a text are plain text; a null doc_id stays null; rows that
repeat count as often as they stand; other columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import path as tokenizer_path
from .byte_bpe import CUT, LONGEST, ByteBPE, byte_bpe
from .common import cut
from .memory import lean, text_batches

VOCABULARY_B = "piece_bpe_32k.model"
#: Chunks that a worker remembers, at most.
REMEMBER = 300_000
#: Bytes of texts that are aligned, and handed on, together, about (a longer text goes by itself).
TOGETHER = 1 << 20
SPACE = "▁"


class Pieces:
    """A sentencepiece model: ids of a text that it puts a space before, and each id's bytes."""

    def __init__(self, file: str):
        import sentencepiece

        with open(file, "rb") as f:
            self.own = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = self.own.get_piece_size()
        self.tokens = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.own.id_to_piece(list(range(n))))]
        assert not any(SPACE in p.lstrip(SPACE) for p in self.own.id_to_piece(list(range(n))))  # else chunks aren't independent
        space = self.own.piece_to_id(SPACE)
        self.blank = [space] if space != self.own.unk_id() else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        made = self.own.encode(texts, num_threads=1)
        return [ids if text else self.blank or [] for ids, text in zip(made, texts)]


def owners(sizes: np.ndarray) -> np.ndarray:
    """The number of the token that each byte belongs to."""
    return np.repeat(np.arange(len(sizes)), sizes)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens of A and B that share bytes, in order, out of the owners of each byte."""
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bytes with which tokens of both A and B end."""
    last = np.ones(len(a), dtype=bool)
    last[:-1] = (a[1:] != a[:-1]) & (b[1:] != b[:-1])
    return np.flatnonzero(last)


class Aligner:
    """What two tokenizers make of texts; known: chunk -> (A tokens, B tokens, groups, links packed as pair numbers), or None if its bytes differ."""

    def __init__(self, file_a: str, file_b: str):
        self.a: ByteBPE = byte_bpe(file_a)
        self.b = Pieces(file_b)
        self.known: dict[str, tuple[int, int, bytes, bytes] | None] = {}
        self.bytes_a = [self.a.tokens.get(i, b"") for i in range(max(self.a.tokens) + 1)]
        self.sizes_a = np.array([len(t) for t in self.bytes_a], dtype=np.int64)
        self.sizes_b = np.array([len(t) for t in self.b.tokens], dtype=np.int64)
        # each id as it is written within a group (row 0) and at the end of its tokenizer's part (row 1)
        self.written_a, self.written_b = (np.array([[b"%d%s" % (i, mark) for i in range(n)] for mark in (b",", end)], object) for n, end in ((len(self.bytes_a), b"|"), (len(self.b.tokens), b";")))
        self.pairs = self.possible_pairs()

    def possible_pairs(self) -> np.ndarray:
        """The pairs of ids of which one is a suffix of the other, as a << 32 | b, ascending."""
        by_bytes: dict[bytes, list[int]] = {}
        for b, token in enumerate(self.b.tokens):
            by_bytes.setdefault(token, []).append(b)
        of_a = {token: a for a, token in enumerate(self.bytes_a) if token}
        found = {a << 32 | b for token, a in of_a.items() for k in range(len(token)) for b in by_bytes.get(token[k:], ())}
        found |= {of_a[token[k:]] << 32 | b for token, bs in by_bytes.items() for k in range(len(token)) if token[k:] in of_a for b in bs}
        return np.array(sorted(found), dtype=np.int64)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair of ids among those that can be linked."""
        return np.searchsorted(self.pairs, a.astype(np.int64) << 32 | b).astype(np.int32)

    def ids(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a.encode(" " + c) for c in chunks], self.b.encode(chunks)

    def align(self, chunks: list[str]) -> Iterator[tuple[int, int, bytes, bytes] | None]:
        """For each chunk, or whole text, with a space before it: its tokens, groups and links, all found in one pass over their bytes."""
        every_a, every_b = self.ids(chunks)
        raw = [(" " + c).encode() for c in chunks]
        bytes_a, bytes_b = self.bytes_a, self.b.tokens
        good = [b"".join([bytes_b[i] for i in y]) == text == b"".join([bytes_a[i] for i in x]) for text, x, y in zip(raw, every_a, every_b)]
        n_a, n_b = np.array([len(x) for x in compress(every_a, good)]), np.array([len(y) for y in compress(every_b, good)])
        a = np.fromiter(chain.from_iterable(compress(every_a, good)), np.int64)
        b = np.fromiter(chain.from_iterable(compress(every_b, good)), np.int64)
        owner_a, owner_b = owners(self.sizes_a[a]), owners(self.sizes_b[b])
        at = cuts(owner_a, owner_b)
        last_a, last_b = owner_a[at], owner_b[at]  # the last tokens of each group
        links = self.numbers(a[last_a], b[last_b])
        # ids as they are written: A's of a group, B's of it, and so on
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[last_a] = ends_b[last_b] = True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = self.written_a[ends_a.astype(int), a]
        written[np.arange(len(b)) + (last_a + 1)[group_b]] = self.written_b[ends_b.astype(int), b]
        written = written.tolist()
        # chunks end with groups
        stop_a, stop_b = np.cumsum(n_a, dtype=int), np.cumsum(n_b, dtype=int)
        stop = np.searchsorted(last_a, stop_a).tolist()
        made = zip(n_a.tolist(), n_b.tolist(), [0, *stop], stop, [0, *(stop_a + stop_b).tolist()], (stop_a + stop_b).tolist())
        links = links.tobytes()
        for ok in good:
            if ok:
                of_a, of_b, p, q, i, j = next(made)
                yield of_a, of_b, b"".join(written[i:j]), links[4 * p : 4 * q]
            else:
                yield None

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(A tokens, B tokens, groups, links) of each text; zeros and nothing for a text without tokens."""
        split = [CUT.split(t) if t else [] for t in texts]
        found = {c: self.known.get(c, self) for c in set(chain.from_iterable(split))}
        new = [c for c, x in found.items() if x is self]
        if new:
            found.update(zip(new, self.align(new)))
        if len(self.known) + len(new) > REMEMBER:
            self.known = {c: x for c, x in found.items() if len(c) <= LONGEST}  # those of now are likelier than those of long ago
        else:
            self.known.update((c, found[c]) for c in new if len(c) <= LONGEST)
        for text, chunks in zip(texts, split):
            parts = [found[c] for c in chunks]
            if None in parts:
                parts = [next(self.align([text]))]
            if not parts or parts[0] is None:
                yield 0, 0, b"", b""
            else:
                n_a, n_b, groups, links = zip(*parts)
                yield sum(n_a), sum(n_b), b"".join(groups)[:-1], b"".join(links)


@functools.cache
def aligner(file_a: str | None = None, file_b: str | None = None) -> Aligner:
    return Aligner(file_a or tokenizer_path("byte_bpe_50k.json"), file_b or tokenizer_path(VOCABULARY_B))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of some TOGETHER bytes of texts each."""
    first, size, texts = 0, 0, []
    for k, scalar in enumerate(batch["text"], 1):
        texts.append(scalar.as_py())
        size += len(texts[-1] or "")
        if size >= TOGETHER or k == batch.num_rows:
            yield first, texts
            first, size, texts = k, 0, []


def alignments(docs: DataFrame, file_a: str | None = None, file_b: str | None = None, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, links (numbers of linked pairs, packed) and, if asked for, groups of each document."""
    names = ["n_a", "n_b", "n_groups", "groups_sha256", "links", *(["groups"] if with_groups else [])]

    def run(batches):
        own = aligner(file_a, file_b)
        for batch in batches:
            for first, texts in _parts(batch):
                rows = [(a, b, len(links) // 4, hashlib.sha256(groups).hexdigest() if groups else "", links, groups.decode()) for a, b, groups, links in own.texts(texts)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)][: len(names)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(texts)), *columns], ["doc_id", *names])

    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + ", groups string" * with_groups
    return rows.mapInArrow(lean(run), schema)


def pair_counts(aligned: DataFrame, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """pair (a number), n: how many links of the corpus hold the pair; summed per task before it moves."""

    def run(batches):
        counts = np.zeros(len(aligner(file_a, file_b).pairs), dtype=np.int64)
        for batch in batches:
            for links in batch["links"]:  # as they lie in the batch
                np.add.at(counts, np.frombuffer(links.as_buffer() or b"", np.int32), 1)
        pair = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts[pair])], ["pair", "n"])

    made = aligned.select("links").mapInArrow(run, "pair long, n long")
    return made.groupBy("pair").agg(F.sum("n").alias("n"))


def linked_ids(counts: DataFrame, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """a, b, n and best (is n the highest of its b?) of all pairs of ids that the corpus links: a mapping from either vocabulary to the other."""

    def run(batches):
        pairs = aligner(file_a, file_b).pairs
        for batch in batches:
            both = pairs[batch["pair"].to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array((both >> 32).astype(np.int32)), pa.array((both & 0xFFFFFFFF).astype(np.int32)), batch["n"]], ["a", "b", "n"])

    made = counts.mapInArrow(run, "a int, b int, n long")
    return made.join(made.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def report(docs: DataFrame, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document."""
    aligned = cut(alignments(docs, file_a, file_b))
    table = pair_counts(aligned, file_a, file_b).toArrow()  # no more rows than pairs that the vocabularies allow
    pair, n = table["pair"].to_numpy(), table["n"].to_numpy()

    def run(batches):
        pairs = aligner(file_a, file_b).pairs
        counts = np.zeros(len(pairs), dtype=np.int64)
        counts[pair] = n
        b = pairs & 0xFFFFFFFF
        most = np.zeros(int(b.max(initial=0)) + 1, dtype=np.int64)
        np.maximum.at(most, b, counts)
        best = counts == most[b]
        for batch in batches:
            links = [np.frombuffer(x.as_buffer() or b"", np.int32) for x in batch["links"]]
            sums = [(len(x), int(best[x].sum()), int(counts[x].sum())) for x in links]
            columns = [pa.array(values, pa.int64()) for values in zip(*sums)] if sums else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_a"], batch["n_b"], batch["n_groups"], *columns, batch["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = dict(aligned.dtypes)["doc_id"]
    return aligned.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

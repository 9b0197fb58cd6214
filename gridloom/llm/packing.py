"""Packing of tokenised documents into sequences of a fixed length, best fit after exact complements.

A document's ids end with an end mark.  A longer one is cut into pieces of a
whole sequence, the first piece being what is left over.  Pieces matter to the
plan by their lengths alone, so the plan is made from one count per length: for
each length, longest first, single lengths, pairs and triples whose sum is
exactly the gap are looked up by that sum and consumed as often as the counts
allow; what remains is placed best fit, longest first.  A step uses up a length
or a group of open sequences, so a plan has a few rows per length whatever the
number of documents, and the driver holds nothing else.

Pieces find their places by their rank among those of the same length.  Ranks
are prefix sums over parts of a length of PART rows or so, dealt by hash: a
length that a third of all pieces have is spread like any other.

Defined cases: null and empty texts are the end mark alone; a null doc_id stays
null; rows that repeat, or share a doc_id, are packed each; other columns don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe, little
from .common import cut, small
from .memory import lean, text_batches

CAPACITY, END = 1024, 2
#: Pieces of one length that are ranked together, about.
PART = 4096
#: Bytes of texts whose pieces are handed on together, about (a longer text goes by itself).
TOGETHER = 2 << 20
#: A pattern: lengths in their order in a sequence, and in how many sequences.
Pattern = tuple[tuple[int, ...], int]


class Available:
    """Counts by length, and the combinations of lengths with a given sum that they allow."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def copies(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.n[x]) // k for x, k in Counter(lengths).items())

    def pair(self, total: int, most: int) -> tuple[int, ...] | None:
        """The pair of this sum, no part over `most`, that can be had most often."""
        a = np.arange((total + 1) // 2, min(total - 1, most) + 1)
        if not len(a):
            return None
        often = np.minimum(self.n[a], self.n[total - a])
        if 2 * a[0] == total:
            often[0] //= 2
        k = len(often) - 1 - int(often[::-1].argmax())
        return (int(a[k]), total - int(a[k])) if often[k] > 0 else None

    def exact(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """A single length, a pair or a triple (`most` lengths at most) whose sum is gap, the longest lengths first."""
        if self.n[gap]:
            return (gap,)
        if most > 1 and (found := self.pair(gap, gap)):
            return found
        if most < 3:
            return None
        for a in np.flatnonzero(self.n[: max(0, gap - 1)])[::-1].tolist():
            if 3 * a < gap:
                break
            self.n[a] -= 1
            found = self.pair(gap - a, a)
            self.n[a] += 1
            if found:
                return (a, *found)
        return None


def exact_complements(left: Available, capacity: int, most: int = 3) -> list[Pattern]:
    """Full sequences; what they use is taken off `left`."""
    out: list[Pattern] = []
    for length in range(capacity, 0, -1):
        while left.n[length]:
            left.n[length] -= 1
            rest = left.exact(capacity - length, most) if length < capacity else ()
            left.n[length] += 1
            if rest is None:
                break
            lengths = (length, *rest)
            times = left.copies(lengths)
            for x in lengths:
                left.n[x] -= times
            out.append((lengths, times))
    return out


def best_fit(left: Available, capacity: int) -> list[Pattern]:
    """The rest, longest first, each into the open sequences of the least gap that takes it; equal sequences are one group."""
    groups: dict[int, list[Pattern]] = defaultdict(list)  # by gap
    for length in np.flatnonzero(left.n)[::-1].tolist():
        count = int(left.n[length])
        for gap in sorted(g for g in groups if g >= length):
            while count and groups[gap]:
                lengths, times = groups[gap].pop()
                each = max(1, min(gap // length, count // times))
                used = min(times, count // each)
                groups[gap - each * length].append((lengths + (length,) * each, used))
                if used < times:
                    groups[gap].append((lengths, times - used))
                count -= used * each
        each = capacity // length
        for per, times in ((each, count // each), (count % each, 1)):
            if per and times:
                groups[capacity - per * length].append(((length,) * per, times))
        left.n[length] = 0
    return [p for some in groups.values() for p in some]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that together hold each length as often as counted.

    Combinations that fill a gap exactly use up short lengths, which where
    there are few of them are missed by the best fit of the rest.  So plans with
    combinations of up to three, two and one lengths, and of none, are made, and
    that of the fewest sequences is taken.
    """
    plans = []
    for most in (3, 2, 1, 0):
        left = Available(counts, capacity)
        plans.append((exact_complements(left, capacity, most) if most else []) + best_fit(left, capacity))
    return min(plans, key=lambda patterns: sum(times for _, times in patterns))


class Places:
    """Where the pieces of a plan lie: runs of ranks of one length, each in the same place of sequences that follow each other."""

    def __init__(self, patterns: list[Pattern]):
        taken: Counter = Counter()
        runs, sequence = [], 0
        for lengths, times in patterns:
            offsets = list(accumulate(lengths, initial=0))
            for length, offset in zip(lengths, offsets):
                runs.append((length, taken[length], sequence, offset))
                taken[length] += times
            sequence += times
        runs.sort()
        self.length, self.rank, self.sequence, self.offset = (np.array(x, dtype=np.int64) for x in (zip(*runs) if runs else [()] * 4))
        self.n_sequences = sequence
        self.first = {int(x): k for k, x in reversed(list(enumerate(self.length)))}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece, by its length and rank (from 0)."""
        run = np.zeros(len(length), dtype=np.int64)
        for x in np.unique(length).tolist():
            own, first = length == x, self.first[x]
            last = int(np.searchsorted(self.length, x, side="right"))
            run[own] = first + np.searchsorted(self.rank[first:last], rank[own], side="right") - 1
        return self.sequence[run] + rank - self.rank[run], self.offset[run]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, file: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, token_ids of each piece of each document."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("token_ids", pa.list_(pa.int32()))] if with_ids else [])]
    mark = little([end])

    def run(batches):
        own = byte_bpe(file)
        for batch in batches:
            size, rows, out = 0, [], [[] for _ in fields]
            for k, scalar in enumerate(batch["text"]):
                text = scalar.as_py()
                ids = own.pack(text) + mark
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for number, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    part = ids[4 * a : 4 * b]
                    rows.append(k)
                    for values, made in zip(out, (number, a, b - a, zlib.crc32(part), np.frombuffer(part, "<i4"))):
                        values.append(made)
                size += len(text or "")
                if size >= TOGETHER or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), *(pa.array(v, t) for v, (_, t) in zip(out, fields))], ["doc_id", *(n for n, _ in fields)])
                    size, rows, out = 0, [], [[] for _ in fields]

    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", token_ids array<int>" * with_ids
    return rows.mapInArrow(lean(run), schema)


def ranked(made: DataFrame, counts: dict[int, int]) -> DataFrame:
    """made with __rank, a piece's number (from 0) among those of its length."""
    spark = made.sparkSession
    parts = {length: -(-n // PART) for length, n in counts.items()}  # a row per length, of which there are as many as a sequence has tokens
    dealt = made.join(F.broadcast(spark.createDataFrame(sorted(parts.items()), "length long, __parts long")), "length")
    dealt = dealt.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "__parts"))
    sizes = dealt.groupBy("length", "__part").count()
    by_part = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "__part", F.coalesce(F.sum("count").over(by_part), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")).cast("long")
    dealt = dealt.withColumn("__nth", within).join(small(before, sum(parts.values())), ["length", "__part"])
    return dealt.withColumn("__rank", F.col("__before") + F.col("__nth") - 1)


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, file: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and token_ids): where each piece of each document lies."""
    made = cut(pieces(docs, capacity, end, file, with_ids))
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    if not counts:
        return made.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = Places(plan(counts, capacity))
    rows = ranked(made, counts).select(*made.columns, "__rank")

    def run(batches):
        for batch in batches:
            sequence, offset = places.of(batch["length"].to_numpy(), batch["__rank"].to_numpy())
            kept = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {kind}" for c, kind in made.dtypes)
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of pack(..., with_ids=True): sequence_id, token_ids, doc_ids and the lengths of the parts, in their order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "token_ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.token_ids").alias("token_ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))

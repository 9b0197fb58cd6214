r"""N-gram Jaccard join: universe partition with the pigeonhole principle.

A document is the set of its distinct 5-word shingles, as 64-bit hashes; two
documents link when 100 * |A & B| >= 80 * |A | B|.

Size bands grow by 1.25, so a set and any set it links with are in the same
band or in neighbouring ones.  A band has its own partition of the universe of
shingles into m segments.  If A links with a set B that is no smaller, they
differ in floor(|A| / 4) = H places at most; so, whichever segments A looks at,
if the differences allowed in them (0 for an equal subset, 1 if one-deletion
neighbourhoods are compared too) sum up, each plus one, to H + 1 or more, then
one segment at least keeps within what it is allowed.  A set is therefore
indexed by the subsets of all segments of its own band's partition and of the
one below, and for the first few segments by their one-deletion neighbourhoods
too.  A partition has more segments than H + 1, so a set need not look at all.

What a look costs is known once the lists are gathered: short lists are free,
so every set looks at them.  The long ones (empty subsets, boilerplate) are
told to the sets that are in them; a set whose short lists reach H + 1 leaves
its long ones alone, others add their shortest ones until they reach it.  The
allocation never changes the result, only the work.

Entries travel packed, some bytes each, to buckets of bounded size; an entry's
subset that is expected in very many sets is dealt over several buckets.  In a
list, all members are compared with one pivot; where members are still in
different components after that, all pairs across components are compared,
but those whose sketches already differ by more than a link allows.  A sketch
holds one bit, the parity of the number of shingles, for each of four to eight
hash bins a shingle; the bits in which two sketches differ are never more than
the shingles in which their sets do.  So no link between components is lost,
and of the pairs that don't link only those just below the threshold are
compared on their whole sets, which decide.  A long list is compared in pairs of
blocks of bounded size.  Documents with equal sets (a 128-bit fingerprint and
the size) are one class, compared once if there are many.

Defined cases: null and empty texts, and those without words, have no set and
link with nothing; fewer than five words make one shingle; rows with one
doc_id are one node, which has the links of all of them, and each row is
returned with its own n_shingles; a null doc_id has no identity: it links with
nothing and its component is null; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as w
from .common import any_names, cut, shuffle_partitions, small
from .graph import components
from .memory import lean, text_batches

WORDS = 5
SIMILARITY = (80, 100)
#: Segments beyond H + 1, as a share and a number; share of segments with one-deletion neighbourhoods.
SLACK, MORE, DELETIONS = 0.12, 3, 0.03
#: A list of more sets is long, and one of empty subsets always.
LONG = 16
#: Bits of a sketch, at least; larger sets have BITS_EACH for a shingle, rounded up to a power of two.
BITS, BITS_EACH = 512, 4
#: Members of a block; a long list is compared in pairs of blocks.
TOGETHER = 10_000
#: Documents of the sample that tells which lists are dealt over several buckets, of so many entries each.
SAMPLE, SPREAD, SPREAD_MOST = 10_000, 50_000, 100_000
#: Classes of equal sets that are compared through one document: the largest ones, of so many documents at least.
CLASSES, CLASS_LEAST = 100_000, 4
#: Entries of a bucket, about.
BUCKET = 1_500_000
IDS_BROADCAST = 500_000
#: Flags in a signature's low bits: its set may look here; a neighbourhood, not the subset; a subset that has neighbourhoods; the empty subset.
_LOOKS, _DELETED, _RAISED, _EMPTY = np.uint64(1), np.uint64(2), np.uint64(4), np.uint64(8)
_FLAGS = np.uint64(15)


# sets


def shingles(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of some texts, sorted by both."""
    raw = w.LOWER[raw]
    start, stop, text = w.words(raw, ends)
    h = w.hashes(raw, start, stop)
    n = np.bincount(text, minlength=len(ends) - 1)
    s = np.zeros(max(0, len(h) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(s)]
    inside = text[: len(s)] == text[WORDS - 1 :] if len(s) else np.zeros(0, bool)
    s, of = w.mix(s[inside]), text[: len(s)][inside]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        at = np.cumsum(n) - n
        own = [w.mix(np.array([sum(int(v) * 0xA0761D6478BD642F ** (i + 1) for i, v in enumerate(h[at[t] : at[t] + n[t]])) + int(n[t]) & (2**64 - 1)], dtype=np.uint64))[0] for t in few]
        s, of = np.concatenate([s, np.array(own, dtype=np.uint64)]), np.concatenate([of, few])
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    if len(s):
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])])
        s, of = s[new], of[new]
    return of, s


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    np.add.at(out, of, values)
    return out


def _describe(batches):
    """doc_id, n, two sums over the set that tell it from others, weights to spare, and its sketch."""
    for batch in batches:
        made = [[] for _ in range(5)]
        for _, raw, ends in w.pieces(batch["text"]):
            of, s = shingles(raw, ends)
            texts = len(ends) - 1
            n = np.bincount(of, minlength=texts)
            made[0].append(n)
            made[1].append(_sums(w.mix(s ^ np.uint64(0x1111)), of, texts).view(np.int64))
            made[2].append(_sums(w.mix(s ^ np.uint64(0x2222)), of, texts).view(np.int64))
            made[3].append(_spare(s, of, n))
            made[4] += sketches(s, of, n)
        arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in made[:4]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays, pa.array(made[4], pa.binary())], ["doc_id", "n", "one", "two", "spare", "sketch"])


def n_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets of these sizes: powers of two, so that a larger sketch folds into a smaller one."""
    return np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(n, 1) * BITS_EACH)).astype(np.int64))


def sketches(s: np.ndarray, of: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set the parity of the number of its shingles in each hash bin, packed."""
    bits = n_bits(n)
    begin = np.concatenate([[0], np.cumsum(bits)])
    place = w.mix(s ^ np.uint64(0x3333)) & (bits[of] - 1).astype(np.uint64)
    at = begin[of] + place.astype(np.int64)
    packed = np.zeros(int(begin[-1]) // 8, np.uint8)
    np.bitwise_xor.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return [packed[a:b].tobytes() for a, b in zip(begin // 8, begin[1:] // 8)]


def folded(packed: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, those longer than `size` bytes folded to it: bins that fall together add their parities."""
    out = np.empty((len(packed), size // 8), np.uint64)
    for k, x in enumerate(packed):
        row = np.frombuffer(x, np.uint64)
        out[k] = row if len(x) == size else np.bitwise_xor.reduce(row.reshape(-1, size // 8), axis=0)
    return out


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ, over the last axis: at most the shingles in which the sets do."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def _spare(s, of, n):
    """Weights that a set has in its own band's partition beyond those that it needs."""
    least = bands(int(n.max(initial=0)))
    band = np.searchsorted(least, np.maximum(n, 1), side="right") - 1
    m, deletions = segments(band, least)
    first = np.concatenate([[0], np.cumsum(m)])
    at = first[of] + _places(s, band[of], m[of])
    size = np.bincount(at, minlength=int(first[-1]))
    text = np.repeat(np.arange(len(n)), m)
    raised = (np.arange(len(text)) - first[text] < deletions[text]) & (size > 1)
    return m + np.bincount(text, weights=raised, minlength=len(n)).astype(np.int64) - (n // 4 + 1)


def _sets(batches):
    """doc_id and the sorted hashes of its set, packed."""
    for batch in batches:
        packed = []
        for _, raw, ends in w.pieces(batch["text"]):
            of, s = shingles(raw, ends)
            at = np.searchsorted(of, np.arange(len(ends)))
            packed += [s[a:b].tobytes() for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(packed, pa.binary())], ["doc_id", "set"])


# the partition of the universe


def bands(largest: int) -> np.ndarray:
    """The least size of each band, and one beyond."""
    out = [1]
    while out[-1] <= max(1, largest):
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 1.25)))
    return np.array(out)


def segments(band: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of segments, number of them with one-deletion neighbourhoods) of the bands' partitions."""
    need = (least[band + 1] - 1) // 4 + 1
    m = np.where(need > 1, np.ceil(need * (1 + SLACK)).astype(np.int64) + MORE, 1)
    return m, np.where(need > 1, np.ceil(m * DELETIONS).astype(np.int64) + 1, 0)


def _places(s, band, m):
    """The segment of each shingle in its band's partition of m segments."""
    seed = w.mix(band.astype(np.uint64) + np.uint64(77))
    return (((w.mix(s ^ seed) >> np.uint64(32)) * m.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _subsets(s, of, band, least):
    """Of each text's partition of `band`: (segment of each shingle, first segment of each text, sizes and signatures of the subsets, band and place of each segment, its text)."""
    m, _ = segments(band, least)
    first = np.concatenate([[0], np.cumsum(m)])
    at = first[of] + _places(s, band[of], m[of])
    total = int(first[-1])
    size = np.bincount(at, minlength=total)
    sums = _sums(w.mix(s), at, total)
    text = np.repeat(np.arange(len(m)), m)
    salt = w.mix(band[text].astype(np.uint64) * np.uint64(1 << 40) + (np.arange(total) - first[text]).astype(np.uint64))
    return at, first, size, sums, salt, text


def _signature(sums, salt):
    """44 bits of hash above the flags' four; two subsets that share one by chance cost a comparison."""
    return (w.mix(sums + salt) >> np.uint64(16)) & ~_FLAGS


def entries(s: np.ndarray, of: np.ndarray, n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature with flags, text) of everything that texts index; n: sizes of their sets."""
    band = np.searchsorted(least, n, side="right") - 1
    large = n > 3  # smaller sets link with equal ones only
    out_sig, out_text = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for below in (0, 1):
        use = large & (band - below >= 0)
        if not use.any():
            continue
        keep = use[of]
        renamed = np.cumsum(use) - 1
        texts = np.flatnonzero(use)
        ss, oo = s[keep], renamed[of[keep]]
        b = band[texts] - below
        at, first, size, sums, salt, text = _subsets(ss, oo, b, least)
        _, deletions = segments(b, least)
        raised = (np.arange(len(text)) - first[text] < deletions[text]) & (size > 1)
        looks = np.uint64(0) if below else _LOOKS
        out_sig.append(_signature(sums, salt) | looks | np.where(raised, _RAISED, np.uint64(0)) | np.where(size == 0, _EMPTY, np.uint64(0)))
        out_text.append(texts[text])
        deleted = raised[at]
        a = at[deleted]
        out_sig.append(_signature(sums[a] - w.mix(ss[deleted]), salt[a]) | _DELETED | looks)
        out_text.append(texts[text[a]])
    return np.concatenate(out_sig), np.concatenate(out_text)


def _index(least, dealt, classes, n_buckets, sampling=False):
    """Batches of (bucket, packed signatures, packed doc_ids); with `sampling`, of the signatures."""

    def flush(held):
        sig, ids = (np.concatenate(x) for x in zip(*held))
        plain = sig & ~_FLAGS
        bucket = (plain >> np.uint64(4)) % np.uint64(n_buckets)
        if len(dealt[0]):
            k = np.minimum(np.searchsorted(dealt[0], plain), len(dealt[0]) - 1)
            salt = w.mix(ids.view(np.uint64)) % dealt[1][k].astype(np.uint64)
            bucket = np.where(dealt[0][k] == plain, (bucket + salt) % np.uint64(n_buckets), bucket)
        # by bucket and doc_id, so that each doc_id is written once for a bucket
        there, place = np.unique(ids, return_inverse=True)
        order = np.argsort(bucket.astype(np.int64) * len(there) + place, kind="stable")
        bucket, sig, place = bucket[order], sig[order], place[order]
        short = sig.view(np.uint8).reshape(-1, 8)[:, :6]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (bucket[1:] != bucket[:-1])]))
        times = np.diff(np.append(new, len(place))).astype(np.uint32)
        names, at = np.unique(bucket, return_index=True)
        cut_at, cut_new = np.append(at, len(bucket)), np.append(np.searchsorted(new, at), len(new))
        pack = lambda x, c: pa.array([x[a:b].tobytes() for a, b in zip(c, c[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pack(short, cut_at), pack(there[place[new]], cut_new), pack(times, cut_new)], ["bucket", "sigs", "ids", "times"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for at, raw, ends in w.pieces(batch["text"]):
                of, s = shingles(raw, ends)
                n = np.bincount(of, minlength=len(ends) - 1)
                if len(classes[0]) and len(s):
                    one = _sums(w.mix(s ^ np.uint64(0x1111)), of, len(ends) - 1).view(np.int64)
                    k = np.minimum(np.searchsorted(classes[0], one), len(classes[0]) - 1)
                    two = _sums(w.mix(s ^ np.uint64(0x2222)), of, len(ends) - 1).view(np.int64)
                    own = (classes[0][k] == one) & (classes[1][k] == two) & (classes[2][k] == n) & (classes[3][k] != ids[at : at + len(n)])
                    keep = ~own[of]
                    s, of = s[keep], of[keep]
                    n = np.where(own, 0, n)
                sig, text = entries(s, of, n, least)
                if sampling:
                    yield pa.RecordBatch.from_arrays([pa.array((sig & ~_FLAGS).view(np.int64))], ["sig"])
                    continue
                held.append((sig, ids[at : at + len(n)][text]))
                size += len(sig)
                if size >= 2_000_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return lean(run)


# candidates


def _lists(dealt):
    """From a bucket's entries: pairs with the pivots of short lists (kind 0: a, b), short lists of three and more (1: list, members), long lists (2: list, members, looks: 0 may not look, 1 subset, 2 subset with neighbourhoods, 3 neighbourhood)."""
    schema = pa.schema([("kind", pa.int32()), ("list", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("members", pa.list_(pa.int64())), ("looks", pa.list_(pa.int32()))])

    def run(table: pa.Table) -> pa.Table:
        short = np.concatenate([np.frombuffer(x, np.uint8) for x in table["sigs"].to_pylist()]).reshape(-1, 6)
        sig = np.zeros((len(short), 8), np.uint8)
        sig[:, :6] = short
        sig = sig.view(np.uint64)[:, 0]
        ids, times = (np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()]) for c, kind in (("ids", np.int64), ("times", np.uint32)))
        ids = np.repeat(ids, times)
        plain = sig & ~_FLAGS
        order = np.argsort(plain, kind="stable")
        sig, ids, plain = sig[order], ids[order], plain[order]
        first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
        length = np.diff(np.append(first, len(plain)))
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        subset = np.maximum.reduceat(((sig & _DELETED) == 0).astype(np.int8), first) > 0
        empty = (sig[first] & _EMPTY) > 0  # so many that each counts as long
        split = np.isin(plain[first], dealt[0])
        kind, of, members, looks = [], [], [], []
        pairs = [np.zeros((0, 2), np.int64)]
        for at in np.flatnonzero(several & subset | split):
            part = slice(first[at], first[at] + length[at])
            own, flags = ids[part], sig[part]
            if split[at] or empty[at] or length[at] > LONG:
                code = np.where(flags & _LOOKS == 0, 0, np.where(flags & _DELETED > 0, 3, np.where(flags & _RAISED > 0, 2, 1)))
                kind.append(2), of.append(int(plain[part.start].view(np.int64))), members.append(own), looks.append(code.astype(np.int32))
                continue
            pivot = own[flags & _DELETED == 0].min()
            others = np.unique(own[own != pivot])
            pairs.append(np.stack([np.full(len(others), pivot), others], axis=1))
            if len(others) > 1:  # lists with the same members count once
                everyone = np.sort(np.append(others, pivot))
                name = int(_sums(w.mix(everyone.view(np.uint64)), np.zeros(len(everyone), int), 1).view(np.int64)[0])
                kind.append(1), of.append(name), members.append(everyone), looks.append(None)
        both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        n, more = len(both), np.zeros(len(kind), np.int64)
        arrays = [np.concatenate([np.zeros(n, int), np.array(kind, dtype=int)]), np.concatenate([np.zeros(n, int), np.array(of, dtype=np.int64)]), np.concatenate([both[:, 0], more]), np.concatenate([both[:, 1], more])]
        return pa.table([*(pa.array(x, f.type) for x, f in zip(arrays, schema)), pa.array([None] * n + members, schema.field("members").type), pa.array([None] * n + looks, schema.field("looks").type)], schema=schema)

    return run


def allocate(long: DataFrame, known: DataFrame) -> DataFrame:
    """(list, doc) of the looks at long lists that sets need: long (list, doc, look, size), known (doc_id, spare)."""
    may = long.filter("look > 0").select("list", "doc", "size", (F.col("look") == 3).alias("neighbour"), F.when(F.col("look") == 2, 2).otherwise(1).alias("weight"))
    # most sets can spare what their long lists weigh; only the others choose among them
    lost = may.groupBy("doc").agg(F.sum("weight").alias("lost"), F.sum((~F.col("neighbour")).cast("int")).alias("subsets"))
    spare = known.groupBy("doc_id").agg(F.min("spare").alias("spare"))
    missing = F.col("lost") - F.col("spare")
    needy = cut(lost.join(spare, F.col("doc") == F.col("doc_id")).filter(missing > 0).select(F.col("doc").alias("d"), missing.alias("missing"), "subsets"))
    may = may.join(small(needy, needy.count(), IDS_BROADCAST), F.col("doc") == F.col("d"))
    order = Window.partitionBy("doc").orderBy("neighbour", "size", "list")
    may = may.withColumn("nth", F.row_number().over(order))
    return may.filter((F.col("nth") <= F.col("missing")) | (F.col("subsets") < F.col("missing"))).select("list", "doc").distinct()


def _apart(table: pa.Table) -> pa.Table:
    """For many pairs of blocks (i, j) of lists: pairs of members in different components, one of which looks, that sizes and sketches don't tell apart."""
    table = table.sort_by([("list", "ascending"), ("i", "ascending"), ("j", "ascending")])
    lists, i, j, docs, cs, ns = (table[x].to_numpy() for x in ("list", "i", "j", "doc", "c", "n"))
    look, blocks = (table[x].to_numpy(zero_copy_only=False) for x in ("looks", "block"))
    packed = table["sketch"].to_pylist()
    first = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    out = [np.zeros((0, 2), np.int64)]
    for a, b in zip(first, np.append(first[1:], len(lists))):
        doc, c, n, looks = docs[a:b], cs[a:b], ns[a:b], look[a:b]
        bits = folded(packed[a:b], min(map(len, packed[a:b])))
        xs, ys = np.flatnonzero(blocks[a:b] == i[a]), np.flatnonzero(blocks[a:b] == j[a])
        step = max(1, 2_000_000 // max(1, len(ys)) // bits.shape[1])
        for at in range(0, len(xs), step):
            x = xs[at : at + step]
            wanted = (c[x][:, None] != c[ys]) & (looks[x][:, None] | looks[ys])
            gap = gaps(bits[x][:, None, :], bits[ys][None, :, :])
            p, q = np.nonzero(_gap_fits(gap, n[x][:, None], n[ys]) & wanted)
            out.append(np.stack([doc[x[p]], doc[ys[q]]], axis=1))
    pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _gap_fits(gap, n_x, n_y):
    """|A ^ B| is at least the gap of the sketches, and at most (|A| + |B|) / 9 if they link; and sizes are near."""
    return (gap * 9 <= n_x + n_y) & (5 * np.minimum(n_x, n_y) >= 4 * np.maximum(n_x, n_y))


def _not_far(batches):
    """The pairs that sizes and sketches don't tell apart."""
    for batch in batches:
        xs, ys = batch["sketch_x"].to_pylist(), batch["sketch_y"].to_pylist()
        least = np.array([min(len(x), len(y)) for x, y in zip(xs, ys)], dtype=np.int64)
        gap = np.zeros(len(xs), np.int32)
        for size in np.unique(least):
            at = np.flatnonzero(least == size)
            for part in np.array_split(at, len(at) * int(size) // 8_000_000 + 1):
                gap[part] = gaps(folded([xs[k] for k in part], int(size)), folded([ys[k] for k in part], int(size)))
        keep = _gap_fits(gap, batch["n_x"].to_numpy(), batch["n_y"].to_numpy())
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _agree(batches):
    """The pairs whose sets are alike enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if SIMILARITY[1] * min(len(x), len(y)) < SIMILARITY[0] * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(SIMILARITY[1] * common >= SIMILARITY[0] * (len(both) - common) and common > 0)
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that link, compared on their whole sets."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = docs.join(small(ids, ids.count(), IDS_BROADCAST), F.col("doc_id") == F.col("id"), "left_semi")
    sets = cut(wanted.select("doc_id", "text").mapInArrow(lean(_sets), "doc_id long, set binary"))
    x, y = (sets.select(F.col("doc_id").alias(f"{c}_id"), F.col("set").alias(c)) for c in "xy")
    both = pairs.join(x, F.col("a") == F.col("x_id")).select("a", "b", "x").join(y, F.col("b") == F.col("y_id")).select("a", "b", "x", "y")
    return cut(both.mapInArrow(lean(_agree), "a long, b long").distinct())


def _dealt(docs: DataFrame, n_docs: int, least, many) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of buckets) of lists that a bounded sample expects to hold more than SPREAD entries."""
    share = min(1.0, SAMPLE / n_docs)
    if n_docs <= SPREAD:  # no list can be as long
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    expected = max(3, SPREAD * share)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))
    often = sample.mapInArrow(_index(least, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), many, 1, sampling=True), "sig long").groupBy("sig").count().filter(F.col("count") >= expected)
    often = often.orderBy(F.desc("count"), "sig").limit(SPREAD_MOST).toArrow()
    sigs, counts = often["sig"].to_numpy().view(np.uint64), often["count"].to_numpy()
    parts = np.ceil(counts / share / SPREAD).astype(np.int64)
    sigs, parts = sigs[parts > 1], parts[parts > 1]
    order = np.argsort(sigs, kind="stable")
    return sigs[order], parts[order]


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    spark = documents.sparkSession
    text_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = cut(docs.mapInArrow(lean(_describe), "doc_id long, n long, one long, two long, spare long, sketch binary"))
    identified = known.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    totals = identified.agg(F.max("n").alias("largest"), F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("docs")).first()
    result = known.select("doc_id", F.col("n").alias("n_shingles"))
    if not totals["docs"]:
        return result.withColumn("component_id", F.col("doc_id"))
    classes = cut(identified.groupBy("one", "two", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    sized = identified.join(classes.select(*[F.col(c).alias(f"c_{c}") for c in ("one", "two", "n", "least")]), (F.col("one") == F.col("c_one")) & (F.col("two") == F.col("c_two")) & (F.col("n") == F.col("c_n")))
    copies = sized.select(F.col("doc_id").alias("a"), F.col("c_least").alias("b"))
    large = classes.filter(F.col("copies") >= CLASS_LEAST).orderBy(F.desc("copies"), "least").limit(CLASSES).select("one", "two", "n", "least").toArrow().sort_by("one")
    many = tuple(large[c].to_numpy() for c in ("one", "two", "n", "least"))
    least = bands(int(totals["largest"]))
    identifiable = docs.filter(F.col("doc_id").isNotNull())
    n_buckets = max(shuffle_partitions(spark), math.ceil(totals["shingles"] * 0.75 / BUCKET))
    dealt = _dealt(identifiable, totals["docs"], least, many)
    packed = identifiable.mapInArrow(_index(least, dealt, many, n_buckets), "bucket int, sigs binary, ids binary, times binary")
    found = cut(packed.groupBy("bucket").applyInArrow(_lists(dealt), "kind int, list long, a long, b long, members array<long>, looks array<int>"))
    # long lists: who needs to look at which; those dealt over buckets are counted together
    long = found.filter("kind = 2").select("list", "members", "looks", F.size("members").cast("long").alias("size"))
    if len(dealt[0]):
        sizes = cut(long.groupBy("list").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select(F.col("list").alias("l"), F.col("size").alias("all")))
        long = long.join(small(sizes, sizes.count()), F.col("list") == F.col("l"), "left").select("list", "members", "looks", F.coalesce("all", "size").alias("size"))
    each = long.select("list", "size", F.explode(F.arrays_zip("members", "looks")).alias("x")).select("list", "size", F.col("x.members").alias("doc"), F.col("x.looks").alias("look"))
    looks = cut(allocate(each, identified))
    pivots = cut(looks.groupBy("list").agg(F.min("doc").alias("pivot")).select(F.col("list").alias("l"), "pivot"))
    looked = long.join(small(pivots, pivots.count(), IDS_BROADCAST), F.col("list") == F.col("l"))
    seen_long = cut(looked.select("list", "pivot", F.explode("members").alias("doc")).select("list", "doc", "pivot").distinct())
    ordered = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    star = seen_long.filter("doc != pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    pairs = cut(ordered(found.filter("kind = 0").select("a", "b").union(star)))
    plain = identified.select("doc_id", "n", "sketch").distinct()
    x, y = (plain.select(*[F.col(c).alias(f"{c}_{k}") for c in plain.columns]) for k in "xy")
    near = pairs.join(x, F.col("a") == F.col("doc_id_x")).join(y, F.col("b") == F.col("doc_id_y")).select("a", "b", "n_x", "n_y", "sketch_x", "sketch_y")
    near = cut(near.mapInArrow(lean(_not_far), "a long, b long").distinct())
    links = cut(copies.union(verify(identifiable, near)))
    found_components = cut(components(links))
    # lists whose members are still apart: pairs across components that haven't been compared
    short = found.filter("kind = 1").dropDuplicates(["list", "members"]).select("list", F.explode("members").alias("doc"))
    seen = short.withColumn("looks", F.lit(True)).union(seen_long.select("list", "doc").join(looks.withColumn("looks", F.lit(True)), ["list", "doc"], "left").select("list", "doc", F.coalesce("looks", F.lit(False))))
    seen = cut(seen.join(found_components, F.col("doc") == F.col("node"), "left").select("list", "doc", "looks", F.coalesce("component", "doc").alias("c")))
    apart = seen.groupBy("list").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo != hi")
    # a long list's members are dealt to blocks; each goes to the pairs of blocks that its own is in
    apart = apart.select(F.col("list").alias("l"), F.ceil(F.col("size") / TOGETHER).cast("int").alias("n_blocks"))
    seen = seen.join(apart, F.col("list") == F.col("l")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("n_blocks")).cast("int"))
    seen = seen.join(plain, F.col("doc") == F.col("doc_id")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    seen = seen.select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "looks", "c", "n", "sketch")
    some = F.pmod(F.xxhash64("list", "i", "j"), F.lit(n_buckets * 4))  # lists are small; a task takes many
    more = seen.groupBy(some.alias("some")).applyInArrow(_apart, "a long, b long")
    more = cut(more.distinct().join(pairs, ["a", "b"], "left_anti"))
    if more.count():
        more = verify(identifiable, more)
        if more.count():
            found_components = cut(components(found_components.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    joined = result.join(found_components, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


@any_names
def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, with all columns, less all but the least document of each component; of rows with one doc_id the first by content stays, those without doc_id all do."""
    found = cut(join(docs))
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = cut(gone)
    kept = docs.join(small(gone, gone.count(), IDS_BROADCAST), F.col("doc_id") == F.col("__gone"), "left_anti")
    repeated = cut(found.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__again")).count().filter("count > 1").select("__again"))
    if n := repeated.count():
        repeated = small(repeated, n, IDS_BROADCAST)
        row = F.struct(*[F.col(c) for c in docs.columns])
        once = kept.join(repeated, F.col("doc_id") == F.col("__again"), "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
        kept = kept.join(repeated, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(once)
    return kept


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM t),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a),
m AS (SELECT doc_id, MIN(node) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN m USING (doc_id)
"""

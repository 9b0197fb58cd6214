r"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts texts into variable chunks
(MIN to MAX bytes) where its top bits are zero, so the cuts move with the
content: an insertion changes the chunks around it only.  A chunk is known by
its 128-bit digest.  Chunks whose digest occurs in two documents or more are
repeated; repeated chunks that touch form a run, and a run of LEAST_WORDS words
or more is a repeated passage.  The occurrence in the least document stays:
what goes is decided chunk by chunk, and touching chunks that lesser documents
hold go if they have LEAST_WORDS words or more, whatever stays next to them.

Chunks travel packed, in buckets by digest.  Those that repeat within one
batch of texts are known to be repeated at once; only the least of them goes
to the digest's bucket and stands there for all, the others are dealt evenly,
so a line that a third of all documents hold is no hot bucket.  As each batch's
least is there, the bucket knows the digest's least document; the others are
later than it, so they travel without their digests, but for those in the
document that stands for them, which share its fate.

Defined cases: null and empty texts have no chunks; a null doc_id has no
identity and takes no part; rows with one doc_id are one document, so what
repeats among them only is not reported, and their spans are united; repeats
inside one document are not reported; cuts never split a code point; texts are
read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as w
from .common import cut, shuffle_partitions
from .memory import lean, text_batches

#: Bytes of a chunk; a cut falls where CUT_BITS top bits of the rolling hash are zero.
MIN, MAX, CUT_BITS = 8, 240, 4
#: Words of a repeated passage, at least: more than two lines of boilerplate, less than what chunks keep of 50 words.
LEAST_WORDS = 26
#: Codes of packed chunks: alone so far, standing for others (with others of its document too), dealt evenly (in the standing one's document).
_ALONE, _STANDS, _STANDS_FOR_OWN, _LATER, _LIKE_OWN = range(5)
#: Chunks that are packed together, and chunks of a bucket, about.
PACK, BUCKET = 1_000_000, 1_000_000
BYTES_A_CHUNK = 22
_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)


def rolling(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] in 16 bits, after each byte of some texts, begun anew in each; older bytes have left the 16 bits."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        before = np.zeros_like(h)
        before[step:] = h[:-step] << np.uint16(step)
        first = (ends[:-1, None] + np.arange(step)).ravel()
        before[first[first < np.repeat(ends[1:], step)]] = 0
        h = h + before
    return h


def cuts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of some texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    letter = np.ones(n + 1, dtype=bool)  # does a code point begin here?
    letter[:n] = (raw & 0xC0) != 0x80
    wanted = ((rolling(raw, ends) >> np.uint16(16 - CUT_BITS)) == 0) & letter[1:]
    last = np.zeros(n + 1, dtype=bool)
    last[ends] = True
    out, begin = [], 0
    for at in (np.flatnonzero(wanted | last[1:]) + 1).tolist():
        over = last[at]
        while at - begin > MAX:  # none for long: cut by length
            begin += MAX
            while not letter[begin]:
                begin -= 1
            out.append(begin)
        if over or at - begin >= MIN:
            if at > begin:
                out.append(at)
            begin = at
    return np.array(out, dtype=np.int64)


_FIELDS = (("hi", np.uint64), ("lo", np.uint64), ("doc", np.int64), ("start", np.uint32), ("size", np.uint8), ("words", np.uint8), ("code", np.uint8))


def chunks(ids: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The chunks of some texts: digest, doc_id, start and size in code points, words that begin in it."""
    stop = cuts(raw, ends)
    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    view, digest = memoryview(raw.tobytes()), xxhash.xxh3_128_digest
    d = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())]), np.uint64).reshape(-1, 2)
    text = np.searchsorted(ends, start, side="right") - 1
    points = np.zeros(len(raw) + 1, np.int32)  # Arrow texts have less than 2 ** 31 bytes
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    begins, _, _ = w.words(raw, ends)
    n_words = np.zeros(len(raw) + 1, dtype=np.int32)
    n_words[begins + 1] = 1
    np.cumsum(n_words, out=n_words)
    return {"hi": d[:, 0], "lo": d[:, 1], "doc": ids[text], "start": (points[start] - points[ends[text]]).astype(np.uint32), "size": (points[stop] - points[start]).astype(np.uint8), "words": (n_words[stop] - n_words[start]).astype(np.uint8), "code": np.full(len(stop), _ALONE, np.uint8)}


def _groups(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Chunks sorted by digest, which group each is in, and does the group have two documents or more."""
    order = np.lexsort((c["lo"], c["hi"]))
    c = {k: v[order] for k, v in c.items()}
    if not len(order):
        return c, order, np.zeros(0, bool)
    new = np.concatenate([[True], (c["hi"][1:] != c["hi"][:-1]) | (c["lo"][1:] != c["lo"][:-1])])
    first = np.flatnonzero(new)
    return c, np.cumsum(new) - 1, np.minimum.reduceat(c["doc"], first) != np.maximum.reduceat(c["doc"], first)


def _planes(v: np.ndarray) -> bytes:
    """Numbers as planes of bytes, the lowest first; the higher ones are runs, which shuffles compress away."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind)[:, 0] if raw else np.zeros(0, kind)


def _pack(n_buckets: int):
    names = [n for n, _ in _FIELDS]

    def flush(held):
        c = {k: np.concatenate([h[k] for h in held]) for k in names}
        c, group, several = _groups(c)
        repeated = several[group]
        home = (c["hi"] % np.uint64(n_buckets)).astype(np.int64)
        # of those known to be repeated the least stands for all in the digest's bucket
        least = np.lexsort((c["start"], c["doc"], group))
        first = least[np.concatenate([[True], group[least][1:] != group[least][:-1]])]
        stands = np.zeros(len(group), dtype=bool)
        stands[first] = True
        own = c["doc"] == c["doc"][first][group]  # in the standing one's document
        for_own = np.bincount(group, weights=own)[group] > 1
        away = repeated & ~stands
        c["code"][repeated & stands] = _STANDS
        c["code"][repeated & stands & for_own] = _STANDS_FOR_OWN
        c["code"][away] = _LATER
        c["code"][away & own] = _LIKE_OWN
        home[away] = (w.mix(c["doc"].view(np.uint64) ^ c["start"].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)[away]
        # those without digest last, by document, whose ids are told by their differences
        bare = c["code"] == _LATER
        order = np.lexsort((c["start"], c["doc"], bare, home))
        home, bare = home[order], bare[order]
        there, at = np.unique(home, return_index=True)
        at = np.append(at, len(home))
        packed = {name: [] for name in names}
        for a, b in zip(at, at[1:]):
            part = order[a:b]
            named = part[: int((~bare[a:b]).sum())]
            for name, kind in _FIELDS:
                v = c[name][named if name in ("hi", "lo") else part].astype(kind)
                packed[name].append(_planes(np.diff(v, prepend=0)) if name == "doc" else v.tobytes() if name in ("hi", "lo") else _planes(v))
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(packed[n], pa.binary()) for n in names)], ["bucket", *names])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for at, raw, ends in w.pieces(batch["text"]):
                held.append(chunks(ids[at : at + len(ends) - 1], raw, ends))
                size += len(held[-1]["doc"])
                if size >= PACK:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return lean(run)


def _repeated(table: pa.Table) -> pa.Table:
    """The chunks of a bucket that are repeated; later: does a lesser document hold the chunk (null: as the one with this digest and document that says so)."""
    parts = {name: [] for name, _ in _FIELDS}
    for row in table.select([n for n, _ in _FIELDS]).to_pylist():
        for name, kind in _FIELDS:
            v = np.frombuffer(row[name], kind) if name in ("hi", "lo") else _from_planes(row[name], kind)
            parts[name].append(np.cumsum(v) if name == "doc" else v)
        fill = np.zeros(len(parts["doc"][-1]) - len(parts["hi"][-1]), np.uint64)
        for name in ("hi", "lo"):
            parts[name][-1] = np.concatenate([parts[name][-1], fill])
    c = {name: np.concatenate(v) for name, v in parts.items()}
    sent = c["code"] >= _LATER
    stay, away = ({k: v[m] for k, v in c.items()} for m in (~sent, sent))
    stay, group, several = _groups(stay)
    later, keep = np.zeros(0, bool), np.zeros(0, bool)
    if len(group):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        later = stay["doc"] > np.minimum.reduceat(stay["doc"], first)[group]
        keep = several[group] | (stay["code"] != _ALONE)
    out = {k: np.concatenate([stay[k][keep], away[k]]) for k in c}
    unknown = out["code"] == _LIKE_OWN
    digest = unknown | (out["code"] == _STANDS_FOR_OWN)
    is_later = np.concatenate([later[keep], np.ones(len(away["doc"]), bool)])
    hi, lo = (pa.array(out[k].view(np.int64), mask=~digest) for k in ("hi", "lo"))
    start = out["start"].astype(np.int64)
    return pa.table({"hi": hi, "lo": lo, "doc_id": out["doc"], "start": start, "end": start + out["size"], "words": out["words"].astype(np.int32), "is_later": pa.array(is_later, mask=unknown)})


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, words, is_later (does a lesser document hold it?) of every occurrence of a chunk that two documents or more hold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    text_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(shuffle_partitions(docs.sparkSession), math.ceil(size / BYTES_A_CHUNK / BUCKET))
    packed = rows.mapInArrow(_pack(n_buckets), "bucket int, hi binary, lo binary, doc binary, start binary, size binary, words binary, code binary")
    found = cut(packed.groupBy("bucket").applyInArrow(_repeated, "hi long, lo long, doc_id long, start long, end long, words int, is_later boolean"))
    own = found.filter("hi IS NOT NULL")  # repeats in the documents that stand for a batch; few
    same = F.max("is_later").over(Window.partitionBy("doc_id", "hi", "lo"))
    names = ("doc_id", "start", "end", "words", "is_later")
    return found.filter("hi IS NULL").select(*names).union(own.withColumn("is_later", same).select(*names))


def passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, end, words, later of each repeated passage; later: start, end of the runs in it of least_words words or more whose every chunk a lesser document holds."""
    found = repeated_chunks(docs)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    before, before_later = F.max("end").over(earlier), F.max(F.when(F.col("is_later"), F.col("end"))).over(earlier)
    found = found.select("doc_id", "start", "end", "words", "is_later", before.alias("before"), before_later.alias("before_later"))
    for name, last in (("", "before"), ("_later", "before_later")):
        found = found.withColumn("opens" + name, F.coalesce((F.col("start") > F.col(last)).cast("int"), F.lit(1)))
        found = found.withColumn("new_words" + name, F.when(F.col("start") < F.col(last), 0).otherwise(F.col("words")))  # less: of another row with this doc_id
    found = found.withColumn("run", F.sum("opens").over(so_far))
    # the least occurrences, null here, are no part of what is later; runs of later chunks lie within runs
    found = found.withColumn("part", F.when(F.col("is_later"), F.sum(F.when(F.col("is_later"), F.col("opens_later"))).over(so_far)))
    ends = (F.min("start").alias("start"), F.max("end").alias("end"), F.sum("new_words").cast("long").alias("words"))
    parts = found.groupBy("doc_id", "run", "part").agg(*ends, F.sum("new_words_later").alias("words_later"))
    is_passage = F.col("part").isNotNull() & (F.col("words_later") >= least_words)
    later = F.array_sort(F.collect_list(F.when(is_passage, F.struct("start", "end"))))
    runs = parts.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), later.alias("later"))
    return runs.filter(F.col("words") >= least_words).select("doc_id", "start", "end", "words", "later")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with repeated passages: doc_id, n_passages, n_words, n_chars, n_later (passages that lesser documents hold, which deduplicated cuts), spans as start:end."""
    runs = passages(docs)
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    rows = runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_passages"), F.sum("words").alias("n_words"), F.sum(F.col("end") - F.col("start")).alias("n_chars"), F.sum(F.size("later").cast("long")).alias("n_later"), spans.alias("s"))
    return rows.withColumn("spans", F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")).drop("s")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with every passage cut from the text that lesser documents hold; all columns stay."""
    later = passages(docs).filter(F.size("later") > 0)
    later = later.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.flatten(F.collect_list("later"))).alias("__spans"))
    joined = docs.join(later, F.col("doc_id") == F.col("__id"), "left")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    step = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("text"))
    left = F.aggregate("__spans", zero, step, lambda s: F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)

r"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  Each passage is described by
the shares of kinds of characters, by how often words repeat at once and how
they concentrate, by lengths, and by a hashed bag of its words, and encoded by
a tanh layer.  A gated attention (tanh times sigmoid) learns from the
documents' labels alone how much each passage tells; the score is a logistic
function of the attention-weighted passage representation.

The model is fitted on the driver on SAMPLE labelled documents at most, those
first in a hashed order, with all passages of each; every document is scored
on all its passages, on the executors.
Rows whose crc32(doc_id as text) mod 5 is 0 are never trained on.

Defined cases: a null or blank text is one passage without features, and gets
its score as others do; a null doc_id counts as held out; of labels that
repeat for a document the lowest holds, null ones hold nothing; without labels
of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import any_names
from .memory import lean, text_batches

PASSAGE = 32
#: Labelled documents that are learnt from, at most.
SAMPLE = 4000
THRESHOLD = 0.3
#: Widths of the passage representation and of the attention; buckets of the bag of words.
HIDDEN, ATTENTION, BUCKETS = 16, 8, 64
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 256, 0.01, 1e-4, 7

#: Kinds of characters: each ASCII sign is one of its own, letters, digits and bytes of other characters go by kind.
_KIND = np.zeros(256, dtype=np.int64)
_signs = [b for b in range(33, 127) if not chr(b).isalnum()]
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 0 if _b == 32 else 1 if _b == 10 else 2 if _b < 33 or _b == 127 else 3 if _b >= 128 else 4 if _c.islower() else 5 if _c.isupper() else 6 if _c.isdigit() else 7 + _signs.index(_b)
KINDS = 7 + len(_signs)
FEATURES = KINDS + 6 + BUCKETS


def passages(raw: np.ndarray, ends: np.ndarray, long: int = 2 * w.PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, where each text's passages begin and the last ends); a long text, which comes by itself, is described piece by piece."""
    if len(ends) == 2 and len(raw) > long:
        made = np.concatenate([_passages(raw[a:b], np.array([0, b - a]))[0] for a, b in w.slices(raw, PASSAGE, long // 2)])
        return made, np.array([0, len(made)])
    return _passages(raw, ends)


def _passages(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_texts = len(ends) - 1
    start, stop, text = w.words(raw, ends)
    n_words = np.bincount(text, minlength=n_texts)
    before = np.cumsum(n_words) - n_words
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    of_word = first[text] + (np.arange(len(text)) - before[text]) // PASSAGE
    total = int(first[-1])
    # each byte belongs to the passage of the last word that began, else to its text's first
    of_byte = np.repeat(first[:-1], np.diff(ends))
    if len(start):
        latest = np.searchsorted(start, np.arange(len(raw)), side="right") - 1 if len(raw) < 64 else np.cumsum(np.bincount(start, minlength=len(raw))) - 1
        of_byte = np.where(latest >= 0, np.maximum(of_byte, of_word[np.maximum(latest, 0)]), of_byte)
    kinds = np.bincount(of_byte * KINDS + _KIND[raw], minlength=total * KINDS).reshape(total, KINDS)
    count = np.bincount(of_word, minlength=total).astype(np.float64)
    h = w.hashes(raw, start, stop)
    repeat = np.zeros((2, total))
    for row, lag in zip(repeat, (1, 2)):
        same = (h[lag:] == h[:-lag]) & (of_word[lag:] == of_word[:-lag])
        row += np.bincount(of_word[lag:], weights=same, minlength=total)
    bag = np.bincount(of_word * BUCKETS + (h >> np.uint64(58)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    size, some = np.maximum(kinds.sum(axis=1), 1), np.maximum(count, 1)
    share = bag / some[:, None]
    letters = np.bincount(of_word, weights=stop - start, minlength=total)
    more = np.stack([repeat[0] / some, repeat[1] / some, (share * share).sum(axis=1), letters / some / 16, count / PASSAGE, share.max(axis=1)], axis=1)
    return np.concatenate([np.sqrt(kinds / size[:, None]), more, np.sqrt(share) / 4], axis=1).astype(np.float32), first


class Model:
    """Gated attention over passages; p: its arrays by name."""

    def __init__(self, p: dict[str, np.ndarray], prior: float = 0.5):
        self.p, self.prior = p, prior

    @classmethod
    def untrained(cls, rng: np.random.Generator) -> "Model":
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        zeros = lambda n: np.zeros(n, dtype=np.float32)
        return cls({"mean": zeros(FEATURES), "scale": zeros(FEATURES) + 1, "W": init(FEATURES, HIDDEN), "b": zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "v": zeros(ATTENTION), "U": init(HIDDEN, ATTENTION), "u": zeros(ATTENTION), "a": init(ATTENTION, 1)[:, 0], "z": init(HIDDEN, 1)[:, 0], "c": zeros(1)})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - p["mean"]) * p["scale"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"] + p["v"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        e = (t * g) @ p["a"]
        sizes = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), sizes))
        weight = e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)
        bag = np.add.reduceat(h * weight[:, None], first[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ p["z"] + p["c"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "bag": bag, "score": score}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(first)
        d = ((f["score"] - y) / len(y)).astype(np.float32)
        d_bag = np.repeat(d[:, None] * p["z"], sizes, axis=0)
        d_weight = (d_bag * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(d_weight * f["weight"], first[:-1]), sizes)
        d_e = (f["weight"] * (d_weight - mean))[:, None]
        d_t, d_g = d_e * p["a"] * f["g"] * (1 - f["t"] ** 2), d_e * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        d_h = (d_bag * f["weight"][:, None] + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ d_h, "b": d_h.sum(axis=0), "V": f["h"].T @ d_t, "v": d_t.sum(axis=0), "U": f["h"].T @ d_g, "u": d_g.sum(axis=0), "a": ((f["t"] * f["g"]) * d_e).sum(axis=0), "z": f["bag"].T @ d, "c": d.sum(keepdims=True)}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.p:
            return np.full(len(first) - 1, self.prior)
        return self.forward(x, first)["score"].astype(np.float64)


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """By Adam on the logistic loss, in a seeded order."""
    if not len(labels) or labels.min() == labels.max():
        return Model({}, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(SEED)
    model = Model.untrained(rng)
    everything = np.concatenate(bags)
    model.p["mean"] = everything.mean(axis=0)
    model.p["scale"] = 1 / (everything.std(axis=0) + 0.02)
    del everything
    y = labels.astype(np.float32)
    names = [n for n in model.p if n not in ("mean", "scale")]
    m, v, step = {n: np.zeros_like(model.p[n]) for n in names}, {n: np.zeros_like(model.p[n]) for n in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            f = model.forward(np.concatenate([bags[i] for i in chosen]), first)
            step += 1
            for n, g in model.gradients(f, first, y[chosen]).items():
                g = g + DECAY * model.p[n]
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.999 * v[n] + 0.001 * g * g
                model.p[n] = model.p[n] - RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    model.p = {n: a.astype(np.float32) for n, a in model.p.items()}
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches):
        for batch in batches:
            made, text = [], batch["text"]
            for _, raw, ends in w.pieces(text):
                x, first = passages(raw, ends)
                x = x.astype(np.float16)
                made += [x[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(made, pa.binary())], ["id", "label", "bag"])

    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("id", F.col("label").cast("int").alias("label"), "text")
    found = rows.mapInArrow(lean(run), "id long, label int, bag binary").groupBy("id").agg(F.min(F.struct("label", "bag")).alias("x")).select("id", "x.label", "x.bag").toArrow().sort_by("id")
    bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for b in found["bag"].to_pylist()]
    return fit(bags, found["label"].to_numpy())


def _scored(model: Model):
    def of(text: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, raw, ends in w.pieces(text):
            out.append(model.scores(*passages(raw, ends)))
        return np.concatenate(out)

    return of


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    of = _scored(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(of(batch["text"]), pa.float64())], ["doc_id", "score"])

    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    scored = rows.mapInArrow(lean(run), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@any_names
def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    of = _scored(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(of(batch["text"]) >= threshold))

    text_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)

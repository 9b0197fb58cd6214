r"""Secret scan: fixed patterns, and a token-efficiency test for strings that no pattern knows.

Words of a language are made of few, long tokens of a vocabulary trained on
text; random strings fall apart into tokens of one or two characters.  A run
of 16 or more key characters is therefore encoded with a tiktoken vocabulary,
and few characters per token expose it, unless it is a known form: a number,
a digest of usual length, a UUID, a date, or a name made of words.  Such spans
(kind random) are added to those of the patterns, where they meet none.

Most texts hold nothing to look at; a pass over the batch's bytes finds those
that do (a superset: long runs of hexadecimal or key characters, or one of the
keywords), and only they are matched exactly.

Defined cases: a null text is empty; empty texts have no spans and the digest
of ""; texts are scanned whole, however long; a null doc_id stays null; there
is one row per row.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_names
from .memory import lean, text_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed patterns; the order is that of kinds at one place.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"[0-9a-f]{16,}+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 16}
#: Key characters; trailing padding belongs to a key.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Characters a token, below which a run is random: with digits among its letters, and of letters alone.  Of random letters (1,500 runs of each length)
#: 1.85 takes 88 % (16) to 95 % (64 long) in lower case, 98 to 100 % in upper and 99.7 to 100 % in mixed case, and 2 of the 1,111 natural runs of sf0.1.
MIXED, LETTERS = 2.1, 1.85
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
HEXADECIMAL = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: A word of a name: one case, or a capital first, or a short number.
NAME_PART = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4}")
REDACTED = "[secret]"


def _encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("secret-scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_made: dict = {}


def _forget() -> None:
    _made.clear()


def chars_per_token(run: str) -> float:
    if "encoding" not in _made:
        _made["encoding"] = _encoding()
    return len(run) / max(1, len(_made["encoding"].encode_ordinary(run)))


def known(run: str) -> bool:
    """Numbers, digests, UUIDs, dates, and names, paths and the like made of words."""
    bare = run.rstrip("=")
    if not any(c.isalpha() for c in bare) or UUID.fullmatch(bare) or HEXADECIMAL.fullmatch(bare) and len(bare) in DIGEST_LENGTHS:
        return True
    parts = [p for p in re.split(r"[-_/+]", bare) if p]
    return len(parts) > 1 and all(NAME_PART.fullmatch(p) for p in parts)


def is_random(run: str) -> bool:
    if known(run):
        return False
    mixed = any(c.isdigit() for c in run)
    return chars_per_token(run) < (MIXED if mixed else LETTERS)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start and kind, in code points, end exclusive."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = [(a, b) for _, a, b in found]
    for m in RUN.finditer(text):
        a, b = m.span()
        if not any(a < e and s < b for s, e in base) and is_random(m[0]):
            found.append(("random", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _table(pattern: str) -> np.ndarray:
    one = re.compile(pattern.encode())
    return np.array([one.fullmatch(bytes([b])) is not None for b in range(256)])


_HEX, _KEY = _table("[0-9a-f]"), _table("[A-Za-z0-9+/_-]")


def _runs(hit: np.ndarray) -> np.ndarray:
    """Starts of 16 hits in a row."""
    for step in (1, 2, 4, 8):
        hit = hit[:-step] & hit[step:]
    return np.flatnonzero(hit)


def worth(texts: pa.Array) -> np.ndarray:
    """Places of the texts that may hold a span; a null text holds none."""
    texts = texts.cast(pa.large_binary())
    ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, int)
    found = [np.zeros(0, int)]
    first = 0
    while first < len(texts):  # some 4 MB at a time, or one text
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + (4 << 20), side="right")) - 1)
        raw = np.frombuffer(data, np.uint8)[ends[first] : ends[last]]
        hits = [_runs(_HEX[raw]), _runs(_KEY[raw])] if len(raw) >= 16 else []
        low = raw.tobytes().lower()
        for word in KEYWORDS:
            hits.append(np.array([m.start() for m in re.finditer(word, low)], dtype=int))
        at = np.unique(np.concatenate(hits)) if hits else np.zeros(0, int)
        found.append(np.unique(np.searchsorted(ends[first : last + 1], at + ends[first], side="right") - 1 + first))
        first = last
    return np.unique(np.concatenate(found))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> for each document."""
    rows = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            texts, made = batch["text"], [[]] * batch.num_rows
            for k in worth(texts).tolist():
                made[k] = [dict(zip(("kind", "start", "end"), s)) for s in spans(texts[k].as_py())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, _SPANS)], ["doc_id", "spans"])

    text_batches(docs.sparkSession)
    return rows.mapInArrow(lean(run, _forget), f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def joined(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scan(docs).select("doc_id", *map(count, KINDS[:-1]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(KINDS[-1]))


@any_names
def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by a mark, overlapping ones by one; all columns stay, n_chars follows the text."""

    def run(batches):
        for batch in batches:
            texts, changed = batch["text"], {}
            for k in worth(texts).tolist():
                text = texts[k].as_py()
                if found := spans(text):
                    out, at = [], 0
                    for _, a, b in found:
                        if a >= at:
                            out += [text[at:a], REDACTED]
                        at = max(at, b)
                    changed[k] = "".join(out) + text[at:]
            if changed:
                places = list(changed)
                mask = np.zeros(batch.num_rows, bool)
                mask[places] = True
                new = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array([changed[k] for k in sorted(places)], texts.type))
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", new)
                if "n_chars" in batch.schema.names:
                    n = batch["n_chars"]
                    new = pa.compute.replace_with_mask(n, pa.array(mask), pa.array([len(changed[k]) for k in sorted(places)], n.type))
                    batch = batch.set_column(batch.schema.get_field_index("n_chars"), "n_chars", new)
            yield batch

    text_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run, _forget), docs.schema)

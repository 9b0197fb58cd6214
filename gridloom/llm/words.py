r"""Words of whole batches of texts as arrays, without a Python step per word.

A word is a run of bytes other than \x20 and \x09-\x0D of a text's UTF-8.  Its
hash is a polynomial in 64 bits over random values of its bytes, taken from
running sums, so its cost does not depend on the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together (a longer text is one piece by itself).
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_random = np.random.default_rng(20_240_501)
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        if n > 8 * PIECE:  # a very long text; don't keep tables of its length
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the information of 64 bits over all of them (the finaliser of a public hash, SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bytes, ends): some texts from place `first` on, their bytes, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = min(len(texts), max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1))
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word."""
    inside = ~SPACES[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[ends] = True
    starts, stops = inside.copy(), inside.copy()
    if len(raw):
        starts[1:] &= ~inside[:-1] | first[1:-1]
        stops[:-1] &= ~inside[1:] | first[1:-1]
    start, stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return start, stop, np.searchsorted(ends, start, side="right") - 1


def hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, wherever it stands; a long text's words are taken some at a time."""
    if len(raw) <= 2 * PIECE:
        return _hashes(raw, start, stop)
    out, k = np.zeros(len(start), np.uint64), 0
    while k < len(start):
        first = int(start[k])
        last = max(k + 1, int(np.searchsorted(stop, first + PIECE, side="right")))
        out[k:last] = _hashes(raw[first : stop[last - 1]], start[k:last] - first, stop[k:last] - first)
        k = last
    return out


def slices(raw: np.ndarray, every: int, size: int = PIECE) -> list[tuple[int, int]]:
    """A long text in pieces of about `size` bytes, each but the first beginning with a word whose number is a multiple of `every`."""
    start, _, _ = words(raw, np.array([0, len(raw)]))
    at = start[every::every]
    cuts, last = [0], 0
    while len(at) and (k := int(np.searchsorted(at, last + size))) < len(at):
        last = int(at[k])
        cuts.append(last)
    return list(zip(cuts, [*cuts[1:], len(raw)]))


def _hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start])

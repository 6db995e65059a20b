"""Anchored windows: the shared core of the exact repeated-window operators.

A *window* is L consecutive symbols (bytes or words) of one document.  Writing one row per
window would multiply the corpus, so windows are dealt in runs:

* every window names its *anchor*, the k-gram of least hash inside it (leftmost on ties).  The
  choice depends on the window's own content only, so equal windows have equal anchors at equal
  offsets;
* consecutive windows with one anchor form a *run* [start, stop) whose text is the *span*
  [start, stop + L - 1).  A run is one row: (anchor hash, span digest, document, start, stop, offset).

Two equal windows lie in runs of equal anchor hash.  Runs of equal (anchor, span) repeat as a
whole and need no further look.  Where one anchor hash has several spans (the edges of a
repeated passage) one run of each class is opened into single windows, keyed by
(anchor hash, offset in the window, window digest).

Anchor hashes only choose and gather: two texts of one anchor hash are looked at together, no more.  What is called equal has
equal 128-bit BLAKE2 digests of its bytes (or, in suffixes.py, of its bytes under an equal anchor).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_RNG.integers(2**62, 2**63)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 2**64)
MIX = U(0x9E3779B97F4A7C15)
POSITION_BITS = 24
#: Symbols hashed in one go; longer documents are cut into overlapping pieces.
PIECE = 1 << 21
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * MIX
    return h ^ (h >> U(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        _POWERS[:] = [np.cumprod(np.r_[U(1), np.full(size, U(b))], dtype=np.uint64) for b in (BASE, BASE_INVERSE)]
    return _POWERS[0], _POWERS[1]


class Hashes:
    """Hashes of any stretch [a, b) of a sequence of 64-bit symbols, by one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _powers(len(symbols))
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.prefix[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.down[a] + (b - a).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in linear time for any w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(symbols: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """The runs of a concatenation of documents (document d holds symbols [bounds[d], bounds[d + 1])).

    Returns arrays doc, start, stop (window starts, relative to the document), anchor (its start,
    relative to the document), anchor_hash.
    """
    none = {c: np.zeros(0, np.int64) for c in ("doc", "start", "stop", "anchor")} | {"anchor_hash": np.zeros(0, np.uint64)}
    if len(symbols) < length:
        return none
    grams = Hashes(symbols).grams(k)
    low = (1 << POSITION_BITS) - 1
    if len(grams) > low:
        raise ValueError("pieces must stay below 2**24 symbols")
    keyed = (grams & ~U(low)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(keyed, length - k + 1) & U(low)).astype(np.int64)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= bounds[doc + 1]
    change = np.empty(len(least), bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(least)]
    keep = inside[first]
    first, last = first[keep], last[keep]
    d, at = doc[first], least[first]
    return {"doc": d, "start": first - bounds[d], "stop": last - bounds[d], "anchor": at - bounds[d],
            "anchor_hash": grams[at]}


def pieces(sizes: np.ndarray, length: int, limit: int = PIECE):
    """Groups of (document, from, to) of at most about `limit` symbols; a longer document is cut into
    pieces that overlap by length - 1 symbols, so every window is in exactly one piece."""
    group, held = [], 0
    for d, n in enumerate(sizes.tolist()):
        at = 0
        while n - at >= length:
            end = min(n, at + limit)
            if held and held + end - at > limit:
                yield group
                group, held = [], 0
            group.append((d, at, end))
            held += end - at
            if end == n:
                break
            at = end - length + 1
    if group:
        yield group


def all_runs(arrays: list[np.ndarray], length: int, k: int) -> dict[str, np.ndarray]:
    """runs() of documents of any size, each an array of 64-bit symbols."""
    out = []
    for group in pieces(np.array([len(a) for a in arrays], np.int64), length):
        part = [arrays[d][a:b] for d, a, b in group]
        r = runs(np.concatenate(part), np.r_[0, np.cumsum([len(x) for x in part])], length, k)
        shift = np.array([a for _, a, _ in group], np.int64)[r["doc"]]
        owner = np.array([d for d, _, _ in group], np.int64)[r["doc"]]
        out.append(r | {"doc": owner} | {c: r[c] + shift for c in ("start", "stop", "anchor")})
    if not out:
        return runs(np.zeros(0, np.uint64), np.zeros(1, np.int64), length, k)
    return {c: np.concatenate([r[c] for r in out]) for c in out[0]}


def digests(data: bytes, a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """128-bit digests of the stretches [a, b)."""
    blake = hashlib.blake2b
    return [blake(data[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist())]


def halves(found: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """Digests as two columns of longs."""
    both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))


def byte_symbols(data: bytes) -> np.ndarray:
    return BYTE_TABLE[np.frombuffer(data, np.uint8)]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes."""
    b = np.frombuffer(data, np.uint8)
    black = np.zeros(len(b) + 2, np.int8)
    black[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    step = np.diff(black)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_symbols(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    return Hashes(byte_symbols(data)).of(starts, ends) | U(1), starts, ends


def packed_spans(start: str, stop: str) -> str:
    """SQL for one span as a long, so that a list of them is one flat array."""
    return f"shiftleft(cast({start} as bigint), 32) | cast({stop} as bigint)"


def span_lists(column: pa.Array) -> list[np.ndarray]:
    """The packed spans of each row of an Arrow list column; null: none."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def union(spans: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and stops of the maximal stretches under packed spans; spans that touch are one stretch."""
    if not len(spans):
        return [], []
    spans = np.sort(spans)
    start, stop = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.r_[True, start[1:] > stop[:-1]]
    return start[new].tolist(), stop[np.r_[new[1:], True]].tolist()


def outside(starts: list[int], stops: list[int], n: int):
    """The stretches of [0, n) between disjoint sorted ones."""
    return zip([0, *stops], [*starts, n])

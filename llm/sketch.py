"""Count-min sketches of hashes over a corpus, merged by cell range.

Every partition counts its hashes in `DEPTH` rows of 2**bits cells that saturate; its sketch travels as sorted,
delta-coded cell lists dealt by cell range, ranges are summed apart, and what comes back is a bitmap of the cells that
reached a count, for each count asked for.  A hash's least cell is never below its count: estimates err upwards only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm import windows as W
from llm.common import texts

DEPTH = 2
#: Cell ranges that are summed apart.
RANGES = 64
#: Cells that a task holds before it sends them.
HELD = 4_000_000


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (W.mix(h + np.uint64((row + 1) * int(W.MIX) % 2**64)) >> np.uint64(64 - bits)) + (np.uint64(row) << np.uint64(bits))


def reached(h: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have all their cells set."""
    out = np.ones(len(h), bool)
    for row in range(DEPTH):
        cell = cells(h, row, bits)
        out &= (bitmap[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return out


def width(hashes: float, most: int) -> int:
    """Bits of a row's cell numbers: eight cells in all for each hash, up to 2**most cells."""
    return min(most, max(16, int(np.ceil(np.log2(8 * hashes + 1))))) - (DEPTH.bit_length() - 1)


def sketch(docs: DataFrame, hashes: Callable[[list[bytes]], Iterable[np.ndarray]], bits: int, counts: tuple[int, ...] = (2,)) -> list[bytes]:
    """A bitmap for each of the counts (65,535 at most): the cells that reached it.  hashes: arrays of hashes from some texts."""
    per, top = (DEPTH << bits) // RANGES, max(counts)

    def flush(held: list[np.ndarray]):
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        edge = np.searchsorted(cell, np.arange(RANGES + 1) * per)
        out = {"part": [], "cells": [], "n": []}
        for p in range(RANGES):
            c, m = cell[edge[p] : edge[p + 1]], n[edge[p] : edge[p + 1]]
            if len(c):
                c = (c - np.uint64(p * per)).astype(np.int64)
                out["part"].append(p)
                out["cells"].append(zlib.compress(np.diff(c, prepend=0).astype(np.uint32).tobytes(), 1))
                out["n"].append(zlib.compress(np.minimum(m, top).astype(np.uint16).tobytes(), 1))
        return pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("n", pa.binary())]))

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for h in hashes(texts(batch)):
                held += [cells(h, row, bits) for row in range(DEPTH)]
                size += DEPTH * len(h)
                if size > HELD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def add(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A range's sketches are added one after another: memory is one range whatever the partitions.
        total = np.zeros(per, np.uint32)
        for batch in batches:
            for x, n in zip(batch.column("cells").to_pylist(), batch.column("n").to_pylist()):
                c = np.cumsum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64))
                total[c] = np.minimum(total[c] + np.frombuffer(zlib.decompress(n), np.uint16), top)
        bitmaps = [zlib.compress(np.packbits(total >= k).tobytes(), 1) for k in counts]
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([bitmaps], pa.list_(pa.binary()))], ["part", "bits"])

    parts = docs.select("text").mapInArrow(count, "part int, cells binary, n binary").groupBy("part").applyInArrow(add, "part int, bits array<binary>").toArrow().to_pylist()
    whole = [bytearray((DEPTH << bits) // 8) for _ in counts]
    for r in parts:
        for out, x in zip(whole, r["bits"]):
            out[r["part"] * per // 8 : (r["part"] + 1) * per // 8] = zlib.decompress(x)
    return [bytes(x) for x in whole]

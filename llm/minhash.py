"""Order MinHash fingerprints of documents, sensitive to edit distance.

Every k-mer of a text's code points carries its occurrence number, so the (k-mer, number) pairs of a text
are distinct.  Each of m permutations selects the `tuple` = 2 pairs of least hash, keeps them in their
text order and hashes the tuple.  Two fingerprints are alike in the share of equal components, which estimates
a similarity that falls with edit distance: both the k-mers and their order must agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import RID, keyed, small_batches
from llm.windows import MIX, Hashes, mix

K, M = 8, 48
#: Keys that the range bounds are taken from.
SAMPLE = 10_000
#: Positions whose permuted hashes are held at once.
PART = 1 << 14
_RNG = np.random.Generator(np.random.PCG64(77))
FACTORS = _RNG.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _RNG.integers(0, 2**32, 4096, dtype=np.uint32)
TOP = np.uint32(2**32 - 1)


def occurrence_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for every k-mer with its occurrence number; a shorter text is one k-mer."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    symbols = mix(codes.astype(np.uint64) + MIX) | np.uint64(1)
    h = Hashes(symbols).grams(min(k, len(codes)))
    order = np.argsort(h)
    s = h[order]
    same = np.r_[False, s[1:] == s[:-1], False]
    again = np.flatnonzero(same[1:] | same[:-1])  # places in sorted order that share their k-mer
    if len(again):
        at = np.sort(order[again])
        at = at[np.argsort(h[at], kind="stable")]
        first = np.flatnonzero(np.r_[True, h[at][1:] != h[at][:-1]])
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        h[at] += nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def order_minhash(codes: np.ndarray, k: int = K, m: int = M) -> np.ndarray:
    """m 64-bit components; all zero for an empty text."""
    full = occurrence_hashes(codes, k)
    if not len(full):
        return np.zeros(m, np.uint64)
    x = (full >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(m)
    best, place = np.empty((m, 0), np.uint32), np.empty((m, 0), np.int64)
    for at in range(0, len(x), PART):
        h = x[at : at + PART] * FACTORS[:m, None] + SHIFTS[:m, None]
        for _ in range(min(2, h.shape[1])):
            j = h.argmin(axis=1)
            best, place = np.c_[best, h[rows, j]], np.c_[place, j + at]
            h[rows, j] = TOP
        if best.shape[1] > 2:
            keep = np.sort(np.argsort(best, axis=1, kind="stable")[:, :2], axis=1)
            best, place = np.take_along_axis(best, keep, 1), np.take_along_axis(place, keep, 1)
    place.sort(axis=1)
    picked = full[place]
    out = mix(picked[:, 0] + np.uint64(1))
    for c in range(1, picked.shape[1]):
        out = mix(out * MIX + picked[:, c])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def text_of(sketch: np.ndarray) -> str:
    """Sixteen hex digits a component."""
    return sketch.astype(">u8").tobytes().hex()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_neighbours(spark: SparkSession, docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how near they are.

    The next document is that of the next (doc_id, text hash), nulls first, and the first after the last.
    Rows are dealt by range of that order; each range also gets the first row of the next, so every text is
    shuffled once.  Null texts are empty: a fingerprint of zeros, alike only to another empty
    one.  Texts below k code points are one k-mer.  A single row is its own next.  Other columns are ignored.
    """
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds from a bounded sample of keys; the range of a row is the number of bounds below it.
    sample = sorted((r["id"] is not None, r["id"] or 0, r["h"]) for r in rows.select("rid").orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("rid.*").collect())
    cut = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    bounds = [F.struct(F.lit(i if known else None).cast("long").alias("id"), F.lit(h).cast("long").alias("h")) for known, i, h in cut]
    place = F.size(F.filter(F.array(*bounds), lambda b: F.col("rid") > b)) if bounds else F.lit(0)
    rows = rows.withColumn("p", place)
    # The first key of each range: a row a range, so it may be broadcast.
    order = lambda r: (r["p"], r["rid"]["id"] is not None, r["rid"]["id"] or 0, r["rid"]["h"])
    firsts = sorted(rows.groupBy("p").agg(F.min("rid").alias("rid")).collect(), key=order)
    heads = spark.createDataFrame([(r["rid"], firsts[i - 1]["p"]) for i, r in enumerate(firsts)], f"rid {RID}, host int")
    to = F.expr("if(host is null, array(struct(p as p, false as guest)), array(struct(p as p, false as guest), struct(host as p, true as guest)))")
    dealt = rows.join(F.broadcast(heads), "rid", "left").withColumn("to", F.explode(to)).select("to.p", "to.guest", "rid", "doc_id", "text")
    dealt = dealt.repartitionByRange(parts, "p").sortWithinPartitions("p", "guest", "rid")

    def run(batches):
        held = None  # the row that waits for its next: (p, id, text, sketch)
        out = []

        def close(following, sketch):
            p, i, text, own = held
            e = edited(text, following)
            other = order_minhash(_codes(e), k, m) if e != text else own
            out.append((i, len(text), hashlib.sha256(e.encode()).hexdigest(), text_of(own), text_of(other), likeness(own, other), likeness(own, sketch)))

        for batch in batches:
            for p, guest, i, data in zip(*(batch.column(c).to_pylist() for c in ("p", "guest", "doc_id", "text"))):
                if guest and (held is None or held[0] != p):
                    continue  # a second row of the same first key
                sketch = order_minhash(_codes(data), k, m)
                if held is not None:
                    close(data, sketch)
                held = None if guest else (p, i, data, sketch)
            if out:
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], NAMES)
                out.clear()

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of neighbours, and pairs with one word between, each hashed to `bits`
bits, present or not.  Words are runs of ASCII letters, digits and non-ASCII characters, in lower case.
FTRL keeps a learning rate for each coordinate and an L1 penalty that leaves most weights at zero; the others are
broadcast.  Training takes a bounded sample of labelled rows: at most `positives` and `negatives` of them, those of
least hash.  Scoring covers every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import windows as W
from llm.common import chunks, small_batches

BITS = 20
POSITIVES, NEGATIVES = 4000, 8000
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 5.0, 0.0, 8
THRESHOLD = 0.7
_INSIDE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
PAIR, SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hashed feature, of each occurrence, for a handful of texts."""
    data = [x.lower().encode() for x in texts]
    b = np.frombuffer(b" ".join(data), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _INSIDE[b]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = W.Hashes(W.BYTE_TABLE[b]).of(starts, ends)
    doc = np.searchsorted(np.cumsum([len(x) + 1 for x in data]), starts, "right")
    shift = np.uint64(64 - bits)
    docs, out = [doc], [h >> shift]
    for gap, salt in ((1, PAIR), (2, SKIP)):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        out.append(W.mix(h[:-gap] * salt + h[gap:])[same] >> shift)
    return np.concatenate(docs), np.concatenate(out).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that aren't zero; index 2**bits is the intercept."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for epoch in range(epochs):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            at, label = rows[i]
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            n[at] = old + g * g
    final = weight(np.arange(size))
    at = np.flatnonzero(final)
    return at, final[at]


def held_out(doc_id):
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[np.ndarray, np.ndarray]:
    """Train in one task on the sample; only the weights that aren't zero reach the driver."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter(~held_out("doc_id"))
    pick = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, positives), (0, negatives))]
    # At most positives + negatives rows of two numbers.
    sample = docs.select("doc_id", "text").join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id")

    def encode(batches):
        for batch in batches:
            text = [x or "" for x in batch.column("text").to_pylist()]
            parts = [np.unique(np.r_[features([x], bits)[1], 1 << bits]) for x in text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))], ["doc_id", "toxic", "at"])

    def learn(batches):
        rows = []
        for batch in batches:
            ids, toxic, lists = (batch.column(c).to_pylist() for c in ("doc_id", "toxic", "at"))
            rows += [(i, len(a), np.array(a, np.int32), y) for i, y, a in zip(ids, toxic, lists)]
        rows.sort(key=lambda r: r[:2])
        at, w = train([r[2:] for r in rows], bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["at", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = sample.mapInArrow(encode, f"doc_id {kind}, toxic int, at array<int>")
    got = encoded.repartition(1).mapInArrow(learn, "at long, w double").toArrow()
    return got.column("at").to_numpy(), got.column("w").to_numpy()


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs plus score and predicted."""
    small = spark.sparkContext.broadcast(model)

    def run(batches):
        w = np.zeros((1 << bits) + 1, np.float64)
        at, values = small.value
        w[at] = values
        for batch in batches:
            text = [x or "" for x in batch.column("text").to_pylist()]
            total = np.full(len(text), w[-1])
            for part in chunks(text):
                doc, f = features(text[part.start : part.stop], bits)
                hit = w[f] != 0
                pair = np.unique(doc[hit] << (bits + 1) | f[hit])
                total[part.start : part.stop] += np.bincount(pair >> (bits + 1), w[pair & ((1 << (bits + 1)) - 1)], len(part))
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    return docs.mapInArrow(run, shape)


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null texts are empty: the intercept's score.  A null doc_id is not held out and has no label.  A doc_id that repeats in
    labels or documents counts once for each match.  Labels other than 0 and 1 are left out; without any label the score is 0.5.
    Labels and ids never enter a score.  Other columns are ignored.
    """
    small_batches(spark)
    model = fit(docs, labels, **how)
    out = score(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")

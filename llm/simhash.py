"""SimHash near-dedup with deletion-variant signatures.

Texts get a 64-bit fingerprint of their word shingles; fingerprints link at `bits` = 2 or fewer differing
bits.  A fingerprint is cut into 2 segments of 32 bits.  Two linked fingerprints differ by at most one
bit in one of the segments, and so share a one-wildcard variant of it: the segment with one bit deleted.
Each distinct fingerprint is indexed under its 64 variants, variants are joined by equality, and the full
distance of what meets is verified.

Only distinct fingerprints are indexed; links and components are among fingerprints, documents join at the end.  A bucket of more than
`bucket` fingerprints isn't paired: its members get, as well, the 65 words within one bit of them.  Two fingerprints are
within two bits exactly if they share such a word, so a bucket of these is a clique and a star suffices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import windows as W
from llm.common import RID, Stages, components, keyed, small_batches, texts

SHINGLE, SEED = 3, 42
BUCKET = 32
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hashes whose bits are summed in one go.
PART = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    text = text.translate(LOWER)
    starts, ends = W.word_bounds(text)
    if not len(starts):
        return 0
    words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    line = b" ".join(words)
    stop = np.cumsum(ends - starts + 1) - 1
    start = np.r_[0, stop[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    hashes = xxhash.xxh64_intdigest
    last = min(shingle, len(words)) - 1
    h = np.array([hashes(line[a:b], SEED) for a, b in zip(start[:n].tolist(), stop[last : last + n].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        ones += np.unpackbits(h[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rid, doc_id, fp (the fingerprint's 64 bits as a long)."""

    def scan(batches):
        for batch in batches:
            fp = np.array([fingerprint(x, shingle) for x in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(fp)], ["rid", "doc_id", "fp"])

    return docs.mapInArrow(scan, f"rid {RID}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def links(st: Stages, prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between fingerprints that connect whatever is linked; prints: fp, each once."""
    half = F.col("fp").bitwiseAND(0xFFFFFFFF)
    parts = prints.withColumn("part", F.explode(F.array(F.struct(F.lit(0).alias("seg"), half.alias("bits")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("bits")))))
    cut = parts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(31))))
    # One key: 31 bits, the place that is left out and the segment.
    variant = F.expr("part.bits & ~shiftleft(1L, j)").bitwiseOR(F.expr("shiftleft(cast(j * 2 + part.seg as long), 32)")).alias("key")
    rows = st.put("variants", cut.select("fp", variant))
    size = st.put("sizes", rows.groupBy("key").count().filter("count > 1"))
    # the same plan at every size: the keys in use are as many as the variants
    small = rows.join(size.filter(F.col("count") <= bucket).hint("merge"), "key")
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    st.put("near", left.join(right, "key").filter("a < b and bit_count(a ^ b) <= 2").select("a", "b").distinct())
    crowd = st.put("crowd", rows.join(size.filter(F.col("count") > bucket), "key", "left_semi").select("fp").distinct())
    st.drop("variants", "sizes")
    ball = crowd.withColumn("word", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")))
    centre = ball.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("word", "a")
    st.put("star", ball.join(centre, "word").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct())
    return st.get("near").unionByName(st.get("star"))


def near_copies(spark: SparkSession, rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rid, doc_id, fp, component (least rid reachable by links) and its component_id (doc_id) of keyed rows."""
    small_batches(spark)
    st = Stages(spark, "simhash")
    prints = st.put("prints", fingerprints(rows.select("rid", "doc_id", "text"), shingle))
    distinct = st.put("distinct", prints.groupBy("fp").agg(F.min("rid").alias("least")))
    roots = components(st, links(st, distinct.select("fp")))
    st.drop("near", "star", "crowd")
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    of = st.put("of", of)
    ids = of.groupBy("root").agg(F.min("least").alias("component"))
    of = st.put("whole", of.join(ids, "root").select("fp", "component", F.col("component.id").alias("component_id")))
    return prints.join(of, "fp", "left")


def dedup_simhash(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like others.  Rows of a null doc_id take part;
    as a component's least id they count as null.  Rows that repeat a doc_id are told apart by their texts.
    Other columns are ignored.  An empty table gives an empty table.
    """
    out = near_copies(spark, keyed(docs), shingle)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

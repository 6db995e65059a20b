"""Exact substring dedup over words, with a count-min prefilter.

A window is `length` consecutive words.  Each word covered by a window whose words also start earlier
(smaller doc_id, or earlier in the same document) is removed.

1. Every partition counts the anchors of its windows (see windows.py) in a count-min sketch (sketch.py).  An
   anchor's count is never below that of a window it stands for, so merged sketches overestimate window counts.
2. A second pass over the texts lets pass only runs whose anchor the merged sketch calls repeated, and
   groups those exactly, by a 128-bit BLAKE2 digest of their words.  Nothing repeated is lost: its cells all reached 2.

The bitmap has 2**`max_bits` bits at most whatever the corpus; its width follows the number of words
up to that bound.  A fuller sketch lets more single windows pass to the exact grouping, nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import windows as W
from llm.common import BATCH_CONF, RID, Stages, chunks, keyed, setting, small_batches, texts
from llm.sketch import reached, sketch, width

LENGTH, GRAM = 20, 5
MAX_BITS = 28
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 500
RUNS = f"rid {RID}, start int, stop int, anchor int, kh long, d1 long, d2 long"
RUN_NAMES = ["rid", "start", "stop", "anchor", "kh", "d1", "d2"]


class Line:
    """The words of a text joined by single spaces, and where they lie."""

    def __init__(self, text: bytes):
        starts, ends = W.word_bounds(text)
        self.text = b" ".join([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        stop = np.cumsum(ends - starts + 1) - 1
        self.begin, self.end = np.r_[0, stop[:-1] + 1], stop

    def digests(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """Of the words [a, b)."""
        return W.digests(self.text, self.begin[a], self.end[b - 1])


def _runs_of(data: list[bytes], length: int, k: int):
    for part in chunks(data):
        r = W.all_runs([W.word_symbols(data[i])[0] for i in part], length, k)
        yield r["doc"] + part.start, r


def repeated_runs(docs: DataFrame, bitmap, length: int, k: int, bits: int) -> DataFrame:
    """Runs whose anchor the sketch calls repeated."""

    def scan(batches):
        seen = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            rid, data = batch.column("rid"), texts(batch)
            for doc, r in _runs_of(data, length, k):
                keep = reached(r["anchor_hash"], seen, bits)
                doc, r = doc[keep], {c: v[keep] for c, v in r.items()}
                d = []
                edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else [0]
                for a, b in zip(edge, edge[1:]):  # the runs of a document lie together
                    d += Line(data[doc[a]]).digests(r["start"][a:b], r["stop"][a:b] + length - 1)
                d1, d2 = W.halves(d)
                i32 = lambda c: pa.array(r[c].astype(np.int32))
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(doc)), i32("start"), i32("stop"), i32("anchor"), pa.array(r["anchor_hash"].view(np.int64)), d1, d2], RUN_NAMES)

    return docs.select("rid", "text").mapInArrow(scan, RUNS)


def open_windows(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """Single windows of the given runs: rid, start, kh, off, d1, d2."""
    wanted = reps.groupBy("rid").agg(F.collect_list(F.struct("start", "stop", "anchor", "kh")).alias("runs"))

    def look(batches):
        for batch in batches:
            row, start, kh, off, d = [], [], [], [], []
            for i, (x, runs) in enumerate(zip(texts(batch), batch.column("runs").to_pylist())):
                n = np.array([r["stop"] - r["start"] for r in runs])
                nth = np.repeat(np.arange(len(runs)), n)
                at = np.concatenate([np.arange(r["start"], r["stop"]) for r in runs])
                row.append(np.full(len(at), i))
                start.append(at.astype(np.int32))
                kh.append(np.array([r["kh"] for r in runs])[nth])
                off.append((np.array([r["anchor"] for r in runs])[nth] - at).astype(np.int32))
                d += Line(x).digests(at, at + length)
            if row:
                whole = [pa.array(np.concatenate(c)) for c in (row, start, kh, off)]
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(whole[0]), *whole[1:], *W.halves(d)], ["rid", "start", "kh", "off", "d1", "d2"])

    return docs.select("rid", "text").join(wanted, "rid").mapInArrow(look, f"rid {RID}, start int, kh long, off int, d1 long, d2 long")


def remove(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts without the words under the marks (rid, start, stop): rid, doc_id, n_words, n_removed, kept_sha256, kept."""
    spans = marks.groupBy("rid").agg(F.collect_list(F.expr(W.packed_spans("start", "stop"))).alias("spans"))

    def cut(batches):
        for batch in batches:
            rid, ids, out = batch.column("rid"), batch.column("doc_id"), {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for x, spans in zip(texts(batch), W.span_lists(batch.column("spans"))):
                starts, ends = (b.tolist() for b in W.word_bounds(x))
                words = [x[a:b] for a, b in zip(starts, ends)]
                stay = [w for a, b in W.outside(*W.union(spans), len(words)) for w in words[a:b]]
                kept = b" ".join(stay)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(stay))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([rid, ids, *(pa.array(out[c], k) for c, k in zip(out, kinds))], ["rid", "doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.join(spans, "rid", "left").select("rid", "doc_id", "text", "spans").mapInArrow(cut, f"rid {RID}, doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def cut_repeats(spark: SparkSession, rows: DataFrame, length: int = LENGTH, gram: int = GRAM, max_bits: int = MAX_BITS) -> DataFrame:
    """What dedup_substrings returns, and rid, of keyed rows."""
    small_batches(spark)
    rows, st = rows.select("rid", "doc_id", "text"), Stages(spark, "substrings")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About 6 bytes a word, 2 / (length - gram + 2) anchors a word.
    bits = width(size / 6 * 2 / (length - gram + 2), max_bits)
    with setting(spark, BATCH_CONF, str(TEXT_ROWS)):
        bitmap = spark.sparkContext.broadcast(sketch(rows, lambda data: (r["anchor_hash"] for _, r in _runs_of(data, length, gram)), bits)[0])
    runs = st.put("runs", repeated_runs(rows, bitmap, length, gram, bits), TEXT_ROWS)
    bitmap.unpersist()
    same = ["kh", "d1", "d2"]
    first = F.min(F.struct("rid", "start", "stop", "anchor")).alias("rep")
    classes = st.put("classes", runs.groupBy(*same).agg(first, F.count("*").alias("n")).select(*same, "n", "rep.*"))
    later = classes.filter("n > 1").select(*same, F.col("rid").alias("rep_rid"), F.col("start").alias("rep_start"))
    end = (F.col("stop") + (length - 1)).alias("stop")
    # both sides are shuffled, so AQE splits a class that fills a task
    whole = runs.join(later, same).filter("rid <> rep_rid or start <> rep_start").select("rid", "start", end)
    st.put("whole", whole)
    st.drop("runs")
    contested = classes.groupBy("kh").count().filter("count > 1").select("kh")
    reps = classes.join(contested, "kh", "left_semi").select("rid", "start", "stop", "anchor", "kh")
    opened = st.put("opened", open_windows(rows, reps, length), TEXT_ROWS)
    st.drop("classes")
    same = ["kh", "off", "d1", "d2"]
    earliest = opened.groupBy(*same).agg(F.min(F.struct("rid", "start")).alias("rep"), F.count("*").alias("n")).filter("n > 1")
    earliest = earliest.select(*same, F.col("rep.rid").alias("rep_rid"), F.col("rep.start").alias("rep_start"))
    single = opened.join(earliest, same).filter("rid <> rep_rid or start <> rep_start").select("rid", "start", (F.col("start") + length).alias("stop"))
    st.put("single", single)
    st.drop("opened")
    return remove(rows, st.get("whole").unionByName(st.get("single")))


def dedup_substrings(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words, joined by a space).

    Null and empty texts have no words and stay; texts below `length` words are never touched.  Of equal
    windows the first in (doc_id, start) stays; a null doc_id comes first.  Identical rows of one doc_id
    are one document.  Other columns are ignored.  An empty table gives an empty table.
    """
    return cut_repeats(spark, keyed(docs), length, gram, max_bits).drop("rid")

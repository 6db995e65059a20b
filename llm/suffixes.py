"""Suffix-array dedup over bytes, on a logarithmic family of indexes.

Every byte covered by a `length`-byte string that also starts anywhere else is removed.

The corpus comes in batches.  A batch gets a sparse suffix array: the suffixes at the anchors of its windows
(windows.py), about one in 70 bytes, as far as `depth` bytes, in the order of their bytes within buckets of the first
`gram` bytes.  Equal suffixes are one entry with a count.  An entry also knows the longest prefix that it shares with any other suffix
(`lcp`: that with a neighbour in the order) and the shortest that would matter (`need`: the bytes that a
window has behind its anchor).

A new batch is merge-scanned against every level there is: two arrays of one layout are merged bucket by bucket without a
shuffle, and neighbours are compared byte by byte.  With a level of its own size it becomes one array of twice
the size, which moves up a level (the logarithmic method): every entry is rewritten O(log batches) times, and every pair of batches
has met when the later was added.  Entries whose lcp reaches their need are *live*.

Only runs of windows at live suffixes can repeat; the bytes before the anchor decide, and are settled exactly.  Runs are classed by a
128-bit digest of all their bytes; a class of several repeats as a whole.  At the edges of a match an anchor has several
classes.  There the windows of one run per class are dealt in blocks of 8 neighbouring offsets: the
bytes that all 8 share (the core) must repeat for any of them to repeat; the 7 bytes on either
side, held in full, tell which of the 8 do.  Blocks that are equal in all repeat as a whole, so only those at an edge are opened.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import windows as W
from llm.common import BATCH_CONF, CLEAN_CONF, RID, Stages, chunks, keyed, setting, small_batches, texts

LENGTH, GRAM, DEPTH = 200, 32, 64
#: Batches the corpus is dealt in; a real feed brings its own.
BATCHES = 4
BLOCK = 8
#: Rows of an Arrow batch of index entries (or of the texts they come from), and of texts.
ENTRY_ROWS, TEXT_ROWS = 2000, 500
#: Off while levels meet: Spark would drop the buckets again after it has dropped the shuffle that they make needless.
UNION_CONF = "spark.sql.unionOutputPartitioning"
BUCKET_CONF = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
ENTRY = "kh long, suffix binary, n long, need int, lcp int"
ENTRY_NAMES = ["kh", "suffix", "n", "need", "lcp"]


def _binary(m: np.ndarray, size: np.ndarray) -> pa.Array:
    """The first size bytes of each row."""
    data = m[np.arange(m.shape[1]) < size[:, None]].tobytes()
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def _matrix(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes padded with zeros, and their lengths."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.diff(ends)
    out = np.zeros((len(column), depth), np.uint8)
    out[np.arange(depth) < size[:, None]] = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else 0
    return out, size


def suffixes(docs: DataFrame, length: int, k: int, depth: int) -> DataFrame:
    """The suffixes at the anchors of all windows: kh, suffix, n, need, lcp (0).  Equal ones of a few texts are one row already."""

    def scan(batches):
        for batch in batches:
            data = texts(batch)
            for part in chunks(data):
                some = [data[i] for i in part]
                r = W.all_runs([W.byte_symbols(x) for x in some], length, k)
                if not len(r["doc"]):
                    continue
                begin = np.cumsum([0, *map(len, some)])[r["doc"]]
                size = np.minimum(depth, r["stop"] + length - 1 - r["anchor"])
                flat = np.r_[np.frombuffer(b"".join(some), np.uint8), np.zeros(depth, np.uint8)]
                m = flat[(begin + r["anchor"])[:, None] + np.arange(depth)]
                m[np.arange(depth) >= size[:, None]] = 0
                # the same key may hide other bytes: those stay rows of their own
                key = W.mix(r["anchor_hash"] + W.mix(W.Hashes(m[:, k:].astype(np.uint64).ravel() + np.uint64(1)).of(*_ends(len(m), depth - k)) + size.astype(np.uint64)))
                _, first, of = np.unique(key, return_index=True, return_inverse=True)
                odd = (m != m[first[of]]).any(axis=1) | (size != size[first[of]])
                n, need = np.bincount(of[~odd], minlength=len(first)), np.full(len(first), length)
                np.minimum.at(need, of[~odd], (length - r["anchor"] + r["start"])[~odd])
                at = np.r_[first, np.flatnonzero(odd)]
                n, need = np.r_[n, np.ones(odd.sum(), np.int64)], np.r_[need, (length - r["anchor"] + r["start"])[odd]]
                yield pa.RecordBatch.from_arrays([pa.array(r["anchor_hash"][at].view(np.int64)), _binary(m[at], size[at]), pa.array(n), pa.array(need.astype(np.int32)), pa.array(np.zeros(len(at), np.int32))], ENTRY_NAMES)

    return docs.select("text").mapInArrow(scan, ENTRY)


def _ends(n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.arange(n) * width
    return a, a + width


def neighbours(entries: DataFrame, depth: int) -> DataFrame:
    """Entries in the order of (kh, suffix) within each partition, equal suffixes as one, with the longest prefix shared with a neighbour.

    A partition streams by; only the last entry waits for the next.
    """

    def scan(batches):
        held = None  # matrix row, size, kh, n, need, lcp of the last entry so far

        def batch_of(kh, m, size, n, need, lcp):
            lcp = np.where(n > 1, size, lcp)
            return pa.RecordBatch.from_arrays([pa.array(kh), _binary(m, size), pa.array(n), pa.array(need.astype(np.int32)), pa.array(lcp.astype(np.int32))], ENTRY_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            m, size = _matrix(batch.column("suffix"), depth)
            kh, n, need, lcp = (batch.column(c).to_numpy().astype(np.int64) for c in ("kh", "n", "need", "lcp"))
            if held is not None:
                m, size, kh, n, need, lcp = (np.concatenate([a, b]) for a, b in zip(held, (m, size, kh, n, need, lcp)))
            differ = m[1:] != m[:-1]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
            same = np.minimum(same, np.minimum(size[1:], size[:-1]))
            new = np.r_[True, (same < size[1:]) | (same < size[:-1]) | (kh[1:] != kh[:-1])]
            first = np.flatnonzero(new)
            n, need, lcp = np.add.reduceat(n, first), np.minimum.reduceat(need, first), np.maximum.reduceat(lcp, first)
            between = same[first[1:] - 1]
            lcp[1:] = np.maximum(lcp[1:], between)
            lcp[:-1] = np.maximum(lcp[:-1], between)
            m, size, kh = m[first], size[first], kh[first]
            if len(first) > 1:
                yield batch_of(*(x[:-1] for x in (kh, m, size, n, need, lcp)))
            held = tuple(x[-1:] for x in (m, size, kh, n, need, lcp))
        if held is not None:
            m, size, kh, n, need, lcp = held
            yield batch_of(kh, m, size, n, need, lcp)

    return entries.sortWithinPartitions("kh", "suffix").mapInArrow(scan, ENTRY)


class Family:
    """Levels of suffix arrays: tables bucketed by the first bytes and sorted, in powers of two of a batch.

    add() takes a batch at any time; live() tells the suffixes that share enough with another of all batches so far.
    """

    def __init__(self, stages: Stages, length: int = LENGTH, gram: int = GRAM, depth: int = DEPTH):
        self.stages, self.spark = stages, stages.spark
        self.length, self.gram, self.depth = length, gram, depth
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.aligned: bool | None = None
        self.scans: list[str] = []
        self.made, self.tag = 0, "suffixes_" + stages.root.rsplit("-", 1)[-1]

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        name = f"{self.tag}_{self.made}"
        with setting(self.spark, CLEAN_CONF, "true"), setting(self.spark, BATCH_CONF, str(ENTRY_ROWS)):
            # neighbours() has sorted the rows; a sortBy here would sort them again
            df.select("*").write.bucketBy(self.buckets, "kh").option("path", self.stages.path(name)).option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self.stages.drop(name)

    def _merged(self, a: str, b: str) -> DataFrame:
        """Both arrays as one.  Equal buckets meet as they lie, and the repartition is void; where Spark sees no buckets, it shuffles.

        The filter keeps Spark from a columnar union, which loses the buckets that it says it has.  Should a union lose them all the
        same, it shows more partitions than buckets, and all merges shuffle.
        """
        sides = [self.spark.table(t).filter("n > 0") for t in (a, b)]
        both = neighbours(sides[0].unionByName(sides[1]).repartition(self.buckets, "kh"), self.depth)
        if self.aligned is None:
            self.aligned = both.rdd.getNumPartitions() == self.buckets
        if not self.aligned:
            self.spark.conf.set(UNION_CONF, "false")  # add() restores it
            both = neighbours(sides[0].unionByName(sides[1]).repartition(self.buckets, "kh"), self.depth)
        return both

    def _live(self, entries: DataFrame) -> DataFrame:
        return entries.filter(F.col("lcp") >= F.least("need", F.lit(self.depth)))

    def add(self, docs: DataFrame) -> None:
        """Index a batch (text): scan it against every level, merging with those of equal size."""
        with setting(self.spark, BUCKET_CONF, "false"), setting(self.spark, UNION_CONF, "true"):
            self._add(docs)

    def _add(self, docs: DataFrame) -> None:
        dealt = suffixes(docs, self.length, self.gram, self.depth).repartition(self.buckets, "kh")
        batch = new = self._write(neighbours(dealt, self.depth))
        size = 1
        for level in sorted(self.levels):
            old = self.levels[level]
            if level == size:
                merged = self._write(self._merged(new, old))
                del self.levels[level]
                self._drop(old)
                if new != batch:
                    self._drop(new)
                new, size = merged, 2 * size
            else:
                self.scans.append(f"scan_{self.made}_{level}")
                self.stages.put(self.scans[-1], self._live(self._merged(batch, old)), ENTRY_ROWS)
        if new != batch:
            self._drop(batch)
        self.levels[size] = new

    def live(self) -> DataFrame:
        """kh, sx (hash of the suffix), lcp of all live suffixes."""
        depth = self.depth

        def name(batches):
            for batch in batches:
                m, size = _matrix(batch.column("suffix"), depth)
                at = np.arange(len(size)) * depth
                sx = W.Hashes(W.BYTE_TABLE[m.ravel()]).of(at, at + size)
                yield pa.RecordBatch.from_arrays([batch.column("kh"), pa.array(sx.view(np.int64)), batch.column("lcp")], ["kh", "sx", "lcp"])

        parts = [self._live(self.spark.table(t)) for t in self.levels.values()] + [self.stages.get(s) for s in self.scans]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.mapInArrow(name, "kh long, sx long, lcp int").groupBy("kh", "sx").agg(F.max("lcp").alias("lcp"))

    def drop(self) -> None:
        for name in self.levels.values():
            self._drop(name)
        for i in range(self.made):  # what a failed call has left
            self.spark.sql(f"drop table if exists {self.tag}_{i + 1}")
        self.stages.drop(*self.scans)
        self.levels, self.scans = {}, []


def suffix_runs(docs: DataFrame, length: int, k: int, depth: int) -> DataFrame:
    """The anchored runs of all windows, each with the hash of its suffix (sx) and a digest of all its bytes (d1, d2)."""

    def scan(batches):
        for batch in batches:
            rid, data = batch.column("rid"), texts(batch)
            for part in chunks(data):
                r = W.all_runs([W.byte_symbols(data[i]) for i in part], length, k)
                flat, end = b"".join([data[i] for i in part]), r["stop"] + length - 1
                begin = np.cumsum([0, *(len(data[i]) for i in part)])[r["doc"]]
                at = begin + r["anchor"]
                sx = W.Hashes(W.byte_symbols(flat)).of(at, np.minimum(at + depth, begin + end)).view(np.int64)
                d = W.digests(flat, begin + r["start"], begin + end)
                i32 = lambda c: pa.array(r[c].astype(np.int32))
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(r["doc"] + part.start)), i32("start"), i32("stop"), i32("anchor"), pa.array(r["anchor_hash"].view(np.int64)), pa.array(sx), *W.halves(d)], ["rid", "start", "stop", "anchor", "kh", "sx", "d1", "d2"])

    return docs.select("rid", "text").mapInArrow(scan, f"rid {RID}, start int, stop int, anchor int, kh long, sx long, d1 long, d2 long")


def edge_blocks(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """The windows of the given runs in blocks of neighbouring offsets.

    k1, k2: digest of anchor, block and core.  left, right: the bytes beside the core, next to it first.
    lo, hi: the places in the block (0: the window that starts with the core) that the run has.  at: the
    core's start.
    """
    wanted = reps.groupBy("rid").agg(F.collect_list(F.struct("start", "stop", "anchor", "kh")).alias("runs"))
    weight = 256 ** np.arange(BLOCK - 1, dtype=np.int64)

    def side(b: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        i = at[:, None] + step * np.arange(BLOCK - 1)
        ok = (i >= 0) & (i < len(b))
        return np.where(ok, b[np.clip(i, 0, len(b) - 1)], 0).astype(np.int64) @ weight

    def look(batches):
        blake = hashlib.blake2b
        for batch in batches:
            out, keys = [], []
            for row, (x, runs) in enumerate(zip(texts(batch), batch.column("runs").to_pylist())):
                b = np.frombuffer(x, np.uint8)
                start, stop, anchor, kh = (np.array([r[c] for r in runs], np.int64) for c in ("start", "stop", "anchor", "kh"))
                least, most = anchor - stop + 1, anchor - start  # offsets of the anchor in its windows
                n = most // BLOCK - least // BLOCK + 1
                nth = np.repeat(np.arange(len(runs)), n)
                block = least[nth] // BLOCK + np.arange(len(nth)) - np.repeat(np.cumsum(n) - n, n)
                at = anchor[nth] - block * BLOCK
                stop_at = at - (BLOCK - 1) + length
                lo, hi = np.maximum(0, least[nth] - block * BLOCK), np.minimum(BLOCK - 1, most[nth] - block * BLOCK)
                head = np.stack([kh[nth], block], axis=1).astype("<i8").tobytes()
                keys += [blake(head[16 * j : 16 * j + 16] + x[i:e], digest_size=16).digest() for j, (i, e) in enumerate(zip(np.maximum(at, 0).tolist(), stop_at.tolist()))]
                out.append((np.full(len(nth), row), at, side(b, at - 1, -1), side(b, stop_at, 1), lo, hi))
            if out:
                row, at, left, right, lo, hi = (pa.array(np.concatenate(c)) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(row), at, *W.halves(keys), left, right, lo, hi], ["rid", "at", "k1", "k2", "left", "right", "lo", "hi"])

    out = docs.select("rid", "text").join(wanted, "rid").mapInArrow(look, f"rid {RID}, at long, k1 long, k2 long, left long, right long, lo long, hi long")
    return out.select("rid", F.col("at").cast("int"), "k1", "k2", "left", "right", F.col("lo").cast("byte"), F.col("hi").cast("byte"))


def edge_marks(st: Stages, blocks: DataFrame, length: int) -> DataFrame:
    """rid, start, stop of the repeated windows in blocks.

    Equal blocks (core, sides and places) are a class and repeat as a whole.  Where a key has several classes, those
    that occur once are held against one of each other class, window by window.
    """
    key = ["k1", "k2"]
    shape = [*key, "left", "right", "lo", "hi"]
    classes = st.put("block_classes", blocks.groupBy(*shape).agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("first")))
    alike = classes.filter("n > 1").select(*shape)
    st.put("block_marks", blocks.join(alike, shape).selectExpr("rid", "at - hi as start", f"at - lo + {length} as stop"))
    several = classes.groupBy(*key).count().filter("count > 1").select(*key)
    low = lambda c, n: f"{c} & (shiftleft(1L, cast(8 * ({n}) as int)) - 1)"
    opened = classes.join(several, key, "left_semi").withColumn("j", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))))
    opened = opened.selectExpr("if(n = 1, first.rid, null) as rid", "first.at - j as start", *key, "j", f"{low('left', 'j')} as l", f"{low('right', f'{BLOCK - 1} - j')} as r")
    opened = st.put("opened", opened)
    window = [*key, "j", "l", "r"]
    twice = opened.groupBy(*window).count().filter("count > 1").select(*window)
    st.put("window_marks", opened.filter("rid is not null").join(twice, window).selectExpr("rid", "start", f"start + {length} as stop"))
    st.drop("opened", "block_classes")
    return st.get("block_marks").unionByName(st.get("window_marks"))


def remove(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts without the bytes under the marks (rid, start, stop)."""
    spans = marks.groupBy("rid").agg(F.collect_list(F.expr(W.packed_spans("start", "stop"))).alias("spans"))

    def cut(batches):
        for batch in batches:
            ids, out = batch.column("doc_id"), [[], [], [], [], []]
            for x, spans in zip(texts(batch), W.span_lists(batch.column("spans"))):
                starts, stops = W.union(spans)
                kept = b"".join([x[a:b] for a, b in W.outside(starts, stops, len(x))])
                row = (len(x), len(x) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept)
                for c, v in zip(out, row):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return docs.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(cut, shape)


def dedup_suffixes(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Null texts are empty.  Texts below `length` bytes are never touched.  Cuts may fall inside a code point, so
    kept is binary.  All of equal strings go, none stays; identical rows of one doc_id are
    one document listed again, and such a document's long strings count as repeated.  Other columns are
    ignored.  An empty table gives an empty table.
    """
    small_batches(spark)
    rows, st = keyed(docs), Stages(spark, "suffixes")
    family = Family(st, length, gram, depth)
    try:
        for b in range(batches):
            family.add(rows.filter(F.pmod(F.xxhash64("rid"), F.lit(batches)) == b))
        live = st.put("live", family.live(), ENTRY_ROWS)
    finally:
        family.drop()
    # windows whose bytes behind the anchor go beyond the longest shared prefix can't repeat
    reach = F.when(F.col("lcp") >= depth, F.col("stop")).otherwise(F.least("stop", F.col("lcp") - length + F.col("anchor") + 1))
    runs = suffix_runs(rows, length, gram, depth).join(live, ["kh", "sx"]).withColumn("reach", reach).filter("reach > start")
    runs = st.put("runs", runs.select("rid", "start", "stop", "anchor", "reach", "kh", "d1", "d2"), TEXT_ROWS)
    st.drop("live")
    same = ["kh", "d1", "d2"]
    classes = st.put("classes", runs.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("rid", "start", "reach", "anchor")).alias("first")))
    # both sides are shuffled, so AQE splits a class that fills a task
    again = classes.filter("n > 1").select(*same)
    st.put("whole", runs.join(again, same).select("rid", "start", (F.col("stop") + (length - 1)).alias("stop")))
    st.drop("runs")
    contested = classes.groupBy("kh").count().filter("count > 1").select("kh")
    reps = classes.join(contested, "kh", "left_semi").select("first.rid", "first.start", F.col("first.reach").alias("stop"), "first.anchor", "kh")
    blocks = st.put("blocks", edge_blocks(rows, reps, length), TEXT_ROWS)
    st.drop("classes")
    marks = edge_marks(st, blocks, length)
    st.drop("blocks")
    return remove(rows, st.get("whole").unionByName(marks))

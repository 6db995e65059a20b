"""Near copies by exact similarity: Jaccard of the sets of `shingle`-word shingles, `similarity` at least.

SimHash (simhash.py) links most near copies without regard to a group's size; its links count here once
the sets prove them.  What it misses is found by prefix filtering, which misses nothing: in any one order of the
shingles, two sets that are similar share a shingle among the first n - ceil(similarity * n) + 1 of each.  The order is
by hash, but shingles that many sets hold (by a count-min sketch of them all) come last, the most common at the very end, so that
common passages rarely meet in a bucket.  Of the prefixes only shingles that a second sketch calls repeated are written.  Estimates err upwards only: the
first decides an order, the second loses none.

A bucket of more than `BUCKET` sets isn't paired at once.  Its members are compared with the one that has most links so far,
components are taken, and the bucket goes on without it, while it has more than one component; pairs within a component need
no look.  What is left when the rounds no longer help is a crowd: sets that share shingles, most of them less alike than asked.
Crowds are cut into blocks, every two blocks meet in a task, and a task sends a spanning forest of the links that it finds: rows
grow with members times blocks, pairs are never rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import windows as W
from llm.common import BATCH_CONF, RID, Stages, components, setting, small_batches, texts
from llm.simhash import BUCKET, LOWER, fingerprints, links
from llm.sketch import reached, sketch, width

SHINGLE, SIMILARITY = 5, 0.8
#: Rounds at most, and the share of rows that a round may leave for another to follow.
ROUNDS, PROGRESS = 6, 0.8
#: Sets that hold a shingle that is put behind others, at least; a level each.
HOT = (33, 100, 300, 1000, 3000, 10_000)
#: Cells of the sketch, as a power of two, at most.
MAX_BITS = 28
SLACK = 1e-9
#: Members of a block of a crowd: the fewest, and the most on average; a crowd has up to BLOCKS blocks before they grow.
FEWEST, MOST, BLOCKS = 256, 2048, 16
#: Shingles of a block on average, at most.
BLOCK_SHINGLES = 1 << 21
#: Cells of the matrix of members and shingles that is multiplied at once.
CELLS = 1 << 22
#: Rows of an Arrow batch of sets, up to 160 kB each.
SET_ROWS = 50
#: Rows of an Arrow batch of texts that become sets.
TEXT_ROWS = 250


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all k consecutive words, ascending; fewer words are one shingle, none are none."""
    words = W.word_symbols(text.translate(LOWER))[0]
    at = np.arange(max(1, len(words) - k + 1) if len(words) else 0)
    return np.unique(W.Hashes(words).of(at, np.minimum(at + k, len(words))))


def heads(data: list[bytes], often: list[bytes], bits: int, k: int, similarity: float) -> tuple[list[int], list[np.ndarray]]:
    """Sizes and prefixes of the sets of some texts; often: the sketch's bitmaps of the levels of HOT."""
    levels, sets = [np.frombuffer(x, np.uint8) for x in often], [shingles(x, k) for x in data]
    out = []
    for h in sets:
        n = len(h) - math.ceil(similarity * len(h) - SLACK) + 1 if len(h) else 0
        rank = np.zeros(len(h), np.int8)
        for level, x in enumerate(levels):
            at = np.flatnonzero(rank == level)  # who has reached a level has reached those below
            rank[at[reached(h[at], x, bits)]] += 1
        out.append(h[np.argsort(rank, kind="stable")[:n]])
    return [len(h) for h in sets], out


def prefixes(base: DataFrame, often, often_bits: int, twice, bits: int, k: int, similarity: float) -> DataFrame:
    """rid, n (size of the set), h (a shingle of its prefix) but those that no other prefix has."""

    def scan(batches):
        seen = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            n, found = heads(texts(batch), often.value, often_bits, k, similarity)
            found = [h[reached(h, seen, bits)] for h in found]
            size = [len(h) for h in found]
            if sum(size):
                at = pa.array(np.repeat(np.arange(len(n)), size))
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(at), pa.array(np.repeat(n, size).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64))], ["rid", "n", "h"])

    return base.select("rid", "text").mapInArrow(scan, f"rid {RID}, n int, h long")


def digests(rows: DataFrame, k: int) -> DataFrame:
    """rid and a digest of the set."""

    def scan(batches):
        for batch in batches:
            out = [hashlib.md5(shingles(x, k).tobytes()).digest() for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.binary())], ["rid", "digest"])

    return rows.select("rid", "text").mapInArrow(scan, f"rid {RID}, digest binary")


def outline(h: np.ndarray) -> np.ndarray:
    """How many of a set's hashes lie in each of some stretches, two to four in one on average."""
    k = max(6, math.ceil(math.log2(max(1, len(h)) / 4)))
    return np.minimum(np.bincount((h >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8)


def shared_at_most(x: np.ndarray, y: np.ndarray) -> int:
    """Hashes that two sets share at most, by their outlines; the finer one is folded."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x.reshape(-1, 2).sum(axis=1)
    return int(np.minimum(x, y).sum())


def shared_by(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x.view(np.uint64), y.view(np.uint64), assume_unique=True))


def compared(pairs: DataFrame, base: DataFrame, k: int, similarity: float, form, shared) -> DataFrame:
    """The pairs (a, b) whose sets, of which `form` is kept, are similar as far as `shared` tells."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()

    def sets(batches):
        for batch in batches:
            found = [shingles(x, k) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([len(h) for h in found], pa.int32()), pa.array([form(h).tobytes() for h in found], pa.binary())], ["rid", "n", "set"])

    def look(batches):
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m")), texts(batch, "x"), texts(batch, "y")):
                both = shared(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
                good.append(both >= similarity * (n + m - both) - SLACK)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # the same plan at every size: the ends are as many as the texts that have near copies
    of = base.select("rid", "text").join(ends.hint("merge"), "rid", "left_semi").mapInArrow(sets, f"rid {RID}, n int, set binary")
    side = lambda c, n, s: of.select(F.col("rid").alias(c), F.col("n").alias(n), F.col("set").alias(s))
    return pairs.hint("merge").join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(look, f"a {RID}, b {RID}")


def possible(pairs: DataFrame, base: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs without those that outlines rule out: a sixteenth of the bytes of the sets."""
    return compared(pairs, base, k, similarity, outline, shared_at_most)


def proved(pairs: DataFrame, base: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    return compared(pairs, base, k, similarity, lambda h: h, shared_by)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes that each of the left sets shares with each of the right ones (a set with itself: not all)."""
    out = np.zeros((len(left), len(right)), np.int32)
    h, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, count = np.unique(h, return_inverse=True, return_counts=True)
    held = count[token] > 1  # a hash that one set alone has counts for nothing
    token, who = (np.cumsum(count > 1) - 1)[token[held]], who[held]
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    step = max(1, CELLS // len(sets))
    for lo in range(0, int((count > 1).sum()), step):
        s, e = np.searchsorted(token, [lo, lo + step])
        m = np.zeros((len(sets), step), np.float32)
        m[who[s:e], token[s:e] - lo] = 1
        out += (m[left] @ m[right].T).astype(np.int32)
    return out


def forest(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that join the classes x of the rows and y of the columns as all links do."""
    root, out = np.arange(max(x.max(initial=-1), y.max(initial=-1)) + 1), []
    for i in range(len(x)):
        at = np.flatnonzero(linked[i])
        for r, first in zip(*np.unique(root[y[at]], return_index=True)):
            if r != root[x[i]]:
                out.append((i, int(at[first])))
                root[root == r] = root[x[i]]
    return out


def crowds(st: Stages, big: DataFrame, base: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) among members of big (h, rid, n, label, c), sets that share a shingle with another one, directly or not.

    The links join labels as all similar pairs do.
    """
    of = components(st, big.select(F.col("c.rid").alias("a"), F.col("rid").alias("b")), "crowd")
    of = st.put("members", big.select("rid", "n", "label").distinct().join(of.select(F.col("node").alias("rid"), F.xxhash64("component").alias("crowd")), "rid"))
    size = of.groupBy("crowd").agg(F.count("*").alias("members"), F.sum("n").alias("hashes"))
    members = F.least(F.lit(MOST), F.greatest(F.lit(FEWEST), F.col("members") / BLOCKS))
    blocks = F.ceil(F.greatest(F.col("members") / members, F.col("hashes") / BLOCK_SHINGLES))
    of = of.join(size.select("crowd", blocks.alias("blocks")), "crowd").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks"))

    def sets(batches):
        for batch in batches:
            found = [shingles(x, k).tobytes() for x in texts(batch)]
            yield batch.select(["rid", "label", "crowd", "blocks", "block"]).append_column("set", pa.array(found, pa.binary()))

    of = st.put("crowd-sets", of.join(base.select("rid", "text"), "rid").mapInArrow(sets, f"rid {RID}, label {RID}, crowd long, blocks long, block long, set binary"), SET_ROWS)
    of = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of = of.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "label", "set")

    def meet(table: pa.Table) -> pa.Table:
        i, j, block = (table.column(c).to_numpy() for c in ("i", "j", "block"))
        found = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        n, known = np.array([len(x) for x in found]), {}
        label = np.array([known.setdefault(tuple(x.values()), len(known)) for x in table.column("label").to_pylist()])
        both = overlaps(found, left, right)
        linked = both >= similarity * (n[left][:, None] + n[right] - both) - SLACK
        links = forest(linked, label[left], label[right])
        rid = table.column("rid").combine_chunks()
        ends = [rid.take(pa.array([int(side[x[at]]) for x in links], pa.int64())) for at, side in enumerate((left, right))]
        return pa.Table.from_arrays(ends, ["a", "b"])

    return of.groupBy("crowd", "i", "j").applyInArrow(meet, f"a {RID}, b {RID}")


def similar_copies(spark: SparkSession, rows: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """rid, component (least rid reachable by links) of keyed rows.  Texts without words are copies of each other."""
    small_batches(spark)
    st = Stages(spark, "similar")
    of = st.put("digests", digests(rows, k), TEXT_ROWS)
    same = st.put("same", of.join(of.groupBy("digest").agg(F.min("rid").alias("node")), "digest").select("node", "rid").distinct())
    st.drop("digests")
    least = same.select(F.col("node").alias("rid")).distinct()
    base = st.put("base", rows.select("rid", "text").join(least, "rid", "left_semi").dropDuplicates(["rid"]))
    fits = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - SLACK
    found = []

    def prove(pairs: DataFrame, sift: bool = False) -> DataFrame:
        """Adds the links among the pairs; component of every node that has a link so far."""
        tag = f"links-{len(found)}"
        pairs = st.put(f"pairs-{tag}", pairs.select("a", "b").distinct())
        if sift:
            pairs = st.put(f"sifted-{tag}", possible(pairs, base, k, similarity), SET_ROWS)
        found.append(st.put(tag, proved(pairs, base, k, similarity), SET_ROWS))
        st.drop(f"pairs-{tag}", f"sifted-{tag}")
        return components(st, functools.reduce(DataFrame.unionByName, found), f"cc-{len(found)}")

    prints = st.put("prints", fingerprints(base.withColumn("doc_id", F.col("rid"))).select("rid", "fp"))
    distinct = st.put("distinct", prints.groupBy("fp").agg(F.min("rid").alias("node")))
    near = links(st, distinct.select("fp"))
    of = lambda c: distinct.select(F.col("fp").alias(f"{c}_fp"), F.col("node").alias(c))
    near = near.withColumnsRenamed({"a": "a_fp", "b": "b_fp"}).join(of("a"), "a_fp").join(of("b"), "b_fp").select("a", "b")
    equal = prints.join(distinct, "fp").filter("rid <> node").select(F.col("node").alias("a"), F.col("rid").alias("b"))
    roots = prove(near.unionByName(equal))
    st.drop("near", "star", "crowd", "prints", "distinct")

    words = (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6  # about 6 bytes a word
    # a cell of the first sketch holds eight shingles or so, far from HOT
    many, few = width(words / 64, MAX_BITS), width(words * (1 - similarity), MAX_BITS)
    with setting(spark, BATCH_CONF, str(TEXT_ROWS)):
        often = spark.sparkContext.broadcast(sketch(base, lambda data: (shingles(x, k) for x in data), many, HOT))
        heads_of = lambda data: heads(data, often.value, many, k, similarity)[1]
        twice = spark.sparkContext.broadcast(sketch(base, heads_of, few)[0])
    firsts = st.put("heads", prefixes(base, often, many, twice, few, k, similarity), TEXT_ROWS)
    often.unpersist()
    twice.unpersist()
    size = firsts.groupBy("h").count().filter("count > 1")
    shared = st.put("shared", firsts.join(size, "h"))
    st.drop("heads")

    tokens = st.put("tokens", shared.groupBy("rid").agg(F.count_if(F.col("count") > BUCKET).alias("rest")))

    def across(met: DataFrame) -> DataFrame:
        """Pairs that meet in a small bucket, are not yet in one component and can be similar.

        Similar sets of n and m share s / (1 + s) of n + m, s the similarity, and so many shingles of their prefixes, not just one.  A pair
        is counted in the small buckets; of the big ones it has no more than its lesser member.
        """
        x, y = (met.select("h", F.col("rid").alias(r), F.col("n").alias(f"n{r}"), F.col("label").alias(f"l{r}")) for r in "ab")
        pairs = x.join(y, "h").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits(F.col("na"), F.col("nb")))
        pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
        other = lambda r: tokens.select(F.col("rid").alias(r), F.col("rest").alias(f"{r}_rest"))
        pairs = pairs.join(other("a"), "a").join(other("b"), "b")
        least = F.greatest("na", "nb") * similarity  # the prefix leaves so many out
        overlap = (F.col("na") + F.col("nb")) * (similarity / (1 + similarity))
        return pairs.filter(F.col("c") + F.least("a_rest", "b_rest") >= overlap - F.ceil(least - SLACK) + 1 - SLACK)

    def labelled(part: DataFrame) -> DataFrame:
        return part.select("h", "rid", "n").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("h", "rid", "n", F.coalesce("component", "rid").alias("label"))

    def degrees() -> DataFrame:
        ends = F.explode(F.array("a", "b")).alias("rid")
        return functools.reduce(DataFrame.unionByName, found).select(ends).groupBy("rid").agg(F.count("*").alias("degree"))

    roots = prove(across(labelled(shared.filter(F.col("count") <= BUCKET))), sift=True)
    big, before = shared.filter(F.col("count") > BUCKET), math.inf
    for turn in range(ROUNDS + 1):
        now = labelled(big).join(degrees(), "rid", "left").fillna(0, ["degree"])
        live = now.groupBy("h").agg(F.max(F.struct("degree", "rid", "n", "label")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h", "c")
        big = st.put(f"big-{turn}", now.join(live, "h"))
        left = big.count()
        if not left:
            break
        if turn == ROUNDS or left > PROGRESS * before:
            found.append(st.put("links-crowd", crowds(st, big, base, k, similarity)))
            roots = components(st, functools.reduce(DataFrame.unionByName, found), "cc-crowd")
            st.drop("members", "crowd-sets")
            break
        before = left
        roots = prove(big.filter((F.col("rid") != F.col("c.rid")) & (F.col("label") != F.col("c.label")) & fits(F.col("n"), F.col("c.n"))).select(F.col("c.rid").alias("a"), F.col("rid").alias("b")))
        big = big.filter(F.col("rid") != F.col("c.rid"))
    of = same.join(roots, "node", "left").select("rid", F.coalesce("component", "node").alias("component"))
    of = st.put("of", of)
    st.drop("same", "base", "shared", "tokens")
    return of

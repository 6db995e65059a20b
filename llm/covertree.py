"""Exact near-duplicate embeddings by dual traversal of cover trees.

Unit vectors link at cosine >= t, that is at distance <= sqrt(2 - 2 t).  Equal vectors are one class and are
compared once.  The upper level of the tree is a net of a bounded sample: at most `cells` centres, sent to all tasks; every
class joins its nearest centre.  A cell is cut by hash into blocks of about `block` classes, so a
dense cell is many blocks.  Each block carries its own cover tree: nested nets with halving radii, each node with the exact
radius of what it covers.

Blocks are dealt in groups, and every pair of groups is one task that gets each of its blocks once: a block is sent to as
many tasks as there are groups, not blocks.  Within it, pairs of blocks whose cells' centres are farther apart than both radii and
the linking distance are dropped; what is left meets block by block.  A block pair is traversed from the roots down, a whole level at once: node pairs
farther apart than their covering radii allow are pruned with everything below them, and the points of
the pairs that survive the last level are compared in double precision.  Only counts and a spanning star per
component leave a block pair, never the pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Stages, components, small_batches

COSINE = 0.95
SAMPLE, CELLS, BLOCK = 1024, 16, 4096
#: Blocks of a group at most: a task holds two groups.
GROUP = 16
LEVELS = 5
#: Margin for bounds in single precision.
SLACK = 1e-3
#: Rows of a block that are compared at once.
TILE = 512
#: Pairs that are left are compared one by one if they are this few among all.
FEW = 32


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows that are zero or not finite become zero."""
    x = x.astype(np.float64)
    ok = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1, initial=0) > 0)
    x = np.where(ok[:, None], x, 0)
    x /= np.where(ok, np.abs(x).max(axis=1, initial=0), 1)[:, None]
    return x / np.where(ok, np.sqrt((x * x).sum(axis=1)), 1)[:, None]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a.astype(np.float32) @ b.astype(np.float32).T)))


class CoverTree:
    """levels: (points that are centres, parent of each in the level above, covering radius); leaf: the last level's node of every point."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        n = len(x)
        centres, leaf = np.zeros(1, np.int64), np.zeros(n, np.int64)
        self.levels = [(centres, np.zeros(1, np.int64), self._radius(x, centres, leaf))]
        radius = 2.0
        for _ in range(levels):
            radius /= 2
            new, of = list(centres), np.full(n, -1, np.int64)
            near = distance(x, x[centres])
            best = near.argmin(axis=1)
            inside = near[np.arange(n), best] <= radius
            of[inside] = best[inside]
            while (rest := np.flatnonzero(of < 0)).size:
                if len(new) > n // 2:  # hardly two points a node: each its own
                    of[rest] = np.arange(len(new), len(new) + len(rest))
                    new += rest.tolist()
                    break
                hit = rest[distance(x[rest], x[rest[:1]])[:, 0] <= radius]
                of[hit], of[rest[0]] = len(new), len(new)
                new.append(rest[0])
            parent = leaf[np.array(new)]
            # a point stays below its own centre only if that lies below the point's node above
            astray = parent[of] != leaf
            if astray.any():
                pair, back = np.unique(np.stack([of[astray], leaf[astray]]), axis=1, return_inverse=True)
                _, first = np.unique(back.ravel(), return_index=True)
                extra = np.flatnonzero(astray)[first]
                of[astray] = len(new) + back.ravel()
                new += extra.tolist()
                parent = leaf[np.array(new)]
            centres, leaf = np.array(new), of
            self.levels.append((centres, parent, self._radius(x, centres, leaf)))
            if len(centres) > n // 2:
                break
        self.leaf = leaf

    @staticmethod
    def _radius(x, centres, leaf):
        d = np.sqrt(np.maximum(0, ((x - x[centres][leaf]) ** 2).sum(axis=1)))
        out = np.zeros(len(centres))
        np.maximum.at(out, leaf, d)
        return out


def _within_reach(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, reach: float) -> np.ndarray:
    """Which nodes lie no farther apart than their radii and the reach, by the cosine of their centres."""
    cosines = a.astype(np.float32) @ b.astype(np.float32).T
    if ra.min() == ra.max() and rb.min() == rb.max():
        return cosines >= np.float32(1 - (ra[0] + rb[0] + reach) ** 2 / 2)
    return cosines >= (1 - (ra[:, None] + rb + reach) ** 2 / 2).astype(np.float32)


def _points_below(tx: CoverTree, u: np.ndarray, ty: CoverTree, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The point pairs below node pairs (u, v), unless they are more than `most`."""
    sizes = [np.bincount(t.leaf, minlength=len(t.levels[-1][0])) for t in (tx, ty)]
    n, m = sizes[0][u], sizes[1][v]
    if int((n * m).sum()) > most:
        return None
    first = [np.cumsum(s) - s for s in sizes]
    order = [np.argsort(t.leaf, kind="stable") for t in (tx, ty)]
    nth = np.repeat(np.arange(len(u)), n * m)
    at = np.arange(len(nth)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    return order[0][first[0][u[nth]] + at // m[nth]], order[1][first[1][v[nth]] + at % m[nth]]


def dual(x: np.ndarray, tx: CoverTree, y: np.ndarray, ty: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked point pairs, part by part."""
    reach = np.sqrt(2 - 2 * cosine) + SLACK
    alive = np.ones((1, 1), bool)
    for level in range(max(len(tx.levels), len(ty.levels))):
        sides = []
        for points, t in ((x, tx), (y, ty)):
            at = min(level, len(t.levels) - 1)
            centres, parent, radius = t.levels[at]
            sides.append((points[centres], parent if at == level and level else np.arange(len(centres)), radius))
        (cx, px, rx), (cy, py, ry) = sides
        alive = (alive.all() or alive[px][:, py]) & _within_reach(cx, rx, cy, ry, reach)
        if not alive.any():
            return
    u, v = np.nonzero(alive)
    found = _points_below(tx, u, ty, v, len(x) * len(y) // FEW)
    if found is not None:  # pair by pair
        for k in range(0, len(found[0]), TILE * TILE):
            i, j = (f[k : k + TILE * TILE] for f in found)
            hit = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            yield i[hit], j[hit]
        return
    for at in range(0, len(x), TILE):
        live = alive[tx.leaf[at : at + TILE]][:, ty.leaf]
        rows, cols = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
        i, j = np.nonzero(live[np.ix_(rows, cols)] & (x[at + rows] @ y[cols].T >= cosine))
        yield at + rows[i], cols[j]


def spanning(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of each point's component."""
    label = np.arange(n)
    while True:
        old = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            return label


def _compare(a: dict, b: dict, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weighted link counts and roots of the linked vectors of one block pair; a is b: of one block."""
    same = b is a
    links, base = np.zeros(len(a["id"]) + (0 if same else len(b["id"])), np.int64), 0 if same else len(a["id"])
    pairs = []
    for i, j in dual(a["x"], a["tree"], b["x"], b["tree"], cosine):
        if same:
            i, j = i[i != j], j[i != j]
        links += np.bincount(i, b["n"][j], len(links)).astype(np.int64)
        if not same:
            links += np.bincount(base + j, a["n"][i], len(links)).astype(np.int64)
        # a tile's pairs shrink to a star: its own spanning forest
        part = spanning(len(links), [(i, base + j)])
        at = np.flatnonzero(part != np.arange(len(part)))
        pairs.append((at, part[at]))
    ids = a["id"] if same else np.r_[a["id"], b["id"]]
    order = np.argsort(ids, kind="stable")  # the least id is the root
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    label = ids[order][spanning(len(ids), [(place[p], place[q]) for p, q in pairs])][place]
    at = np.flatnonzero(links)
    return ids[at], links[at], label[at]


def _open(blob: bytes) -> dict:
    out = pickle.loads(blob)
    return out | {"x": unit(out["x"])}


def layout(stats: dict[tuple[int, int], int], tasks: int) -> list[tuple[int, int, int, int, int, int]]:
    """dim, cell, blocks, first (number of its first block), size (blocks in a group), groups, of every cell with vectors.

    stats: (dim, cell) -> blocks.  Groups are as large as `tasks` pairs of them allow, GROUP blocks at most.
    """
    out = []
    for dim in sorted({d for d, _ in stats}):
        cells = sorted((c, n) for (d, c), n in stats.items() if d == dim)
        total = sum(n for _, n in cells)
        size = max(1, min(GROUP, math.ceil(total / math.sqrt(2 * tasks))))
        first = 0
        for c, n in cells:
            out.append((dim, c, n, first, size, -(-total // size)))
            first += n
    return out


def link_embeddings(spark: SparkSession, table: DataFrame, cosine: float = COSINE, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept.

    Null vectors, zero vectors and such with null or non-finite components link with nothing.  Only vectors of one length
    are compared.  Rows that repeat a vec_id are other vectors to one another, but one node of a component; a
    null vec_id counts as the least.  Equal vectors go by a 64-bit hash.  Other columns are ignored.  An empty table gives an empty table.
    """
    small_batches(spark)
    st = Stages(spark, "embeddings")
    good = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = table.select(F.col("vec_id").alias("given"), F.struct(F.col("vec_id").cast("long").alias("id")).alias("id"), F.col("embedding").alias("v"))
    rows = rows.withColumn("cid", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("v")))
    # A class of equal vectors goes by a hash of the vector: vec_ids may be null or repeated.
    classes = st.put("classes", rows.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")))
    sample = classes.orderBy(F.xxhash64("cid"), "cid").select("v").limit(SAMPLE).toArrow().column("v").to_pylist()
    nets: dict[int, np.ndarray] = {}
    for size in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == size]))
        tree = CoverTree(x)
        fits = [c for c, _, _ in tree.levels if len(c) <= cells]
        deeper = next((c for c, _, _ in tree.levels if len(c) > cells), fits[-1])
        nets[size] = x[deeper[:cells]] if len(fits[-1]) < cells // 2 else x[fits[-1]]

    def place(batches):
        for batch in batches:
            v = batch.column("v").to_pylist()
            size = np.array([len(x) for x in v])
            cell, far = np.zeros(len(v), np.int32), np.full(len(v), 2.0)
            for one in set(size.tolist()) & set(nets):
                at = np.flatnonzero(size == one)
                x = unit(np.array([v[i] for i in at]))
                d = np.sqrt(np.maximum(0, np.stack([((x - c) ** 2).sum(axis=1) for c in nets[one]], axis=1)))
                cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), batch.column("v"), pa.array(size, pa.int32()), pa.array(cell), pa.array(far)], ["cid", "n", "v", "dim", "cell", "far"])

    vector = classes.schema["v"].dataType.simpleString()
    placed = st.put("placed", classes.select("cid", "n", "v").mapInArrow(place, f"cid long, n long, v {vector}, dim int, cell int, far double"))
    # at most `cells` rows for each vector length
    held = {(r["dim"], r["cell"]): (r["far"], r["count"]) for r in placed.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count("*").alias("count")).collect()}
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    near = {(d, c, o) for d, c in held for e, o in ((d, x) for x in range(cells + 1)) if (e, o) in held and (d not in nets or float(np.sqrt(((nets[d][c] - nets[d][o]) ** 2).sum())) <= held[d, c][0] + held[e, o][0] + reach)}
    plan = layout({k: -(-n // block) for k, (_, n) in held.items()}, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = spark.createDataFrame(plan, "dim int, cell int, blocks int, first int, size int, groups int")
    dealt = placed.join(F.broadcast(counts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("grp", F.floor((F.col("first") + F.col("part")) / F.col("size")).cast("int"))

    def pack(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        dim, cell, grp, _, groups = (k.as_py() for k in keys)
        x = np.array(t.column("v").to_pylist(), np.float64)
        tree = CoverTree(unit(x))
        narrow = pa.types.is_float32(t.schema.field("v").type.value_type)
        blob = pickle.dumps({"id": t.column("cid").to_numpy(), "n": t.column("n").to_numpy(), "x": x.astype(np.float32) if narrow else x, "tree": tree, "cell": cell}, 5)
        for other in range(groups):
            low, high = sorted((grp, other))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "low": pa.array([low], pa.int32()), "high": pa.array([high], pa.int32()), "side": pa.array([int(grp > other)], pa.int32()), "blob": pa.array([blob], pa.binary())})

    def meet(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, low, high = (k.as_py() for k in keys)
        sides: tuple[list, list] = ([], [])
        for b in batches:
            for s, x in zip(b.column("side").to_pylist(), b.column("blob").to_pylist()):
                sides[s].append(x)
        for at, one in enumerate(sides[0]):
            a = _open(one)
            for two in [None, *sides[0][at + 1 :]] if low == high else sides[1]:
                b = a if two is None else _open(two)
                if (dim, a["cell"], b["cell"]) in near:
                    ids, links, root = _compare(a, b, cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], ["cid", "links", "root"])

    packed = dealt.select("dim", "cell", "grp", "part", "groups", "cid", "n", "v").groupBy("dim", "cell", "grp", "part", "groups").applyInArrow(pack, "dim int, low int, high int, side int, blob binary")
    found = st.put("found", packed.groupBy("dim", "low", "high").applyInArrow(meet, "cid long, links long, root long"))
    st.drop("placed")
    roots = components(st, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    few = classes.select("cid", "n", "least")
    full = few.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    full = st.put("whole", full.select("cid", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("root")))
    # two classes of one least id stay two components, of the same component_id
    ids = full.groupBy("root").agg(F.min("least").alias("component"))
    full = st.put("of", full.join(ids, "root").select("cid", "n", "links", "component"))
    st.drop("found", "whole", "classes")
    root = F.coalesce("component", "id")
    linked = rows.select("given", "id", "cid").join(full, "cid", "left")
    return linked.select(F.col("given").alias("vec_id"), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).alias("n_links"), root["id"].alias("component_id"), (F.col("id") == root).alias("kept"))

"""Products of sparse vectors, many at once: the entries of a block that are nearest to each query of a chunk."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = "q string, s1 string, name_cos double, addr_cos double"
#: Cells of the matrix queries x entries that are added up in one go; entries of which the largest product is taken first.
CELLS, STRIDE = 1 << 18, 64
#: More than rounding to six places moves a score.
SLACK = 3e-6


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to six places as Spark does: by the decimal that a double prints as."""
    u = x * 1e6
    out = np.floor(u + 0.5)
    for i in np.flatnonzero(np.abs(u - np.floor(u) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out / 1e6


def _vectors(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """ids in their order, and for each value its row, term and weight."""
    table = table.take(pc.sort_indices(table["entity_id"].cast(pa.binary())))
    terms, w = (pa.concat_arrays(table[c].chunks) if table[c].num_chunks else pa.array([], table[c].type) for c in ("term", "w"))
    size = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    return table["entity_id"].combine_chunks(), np.repeat(np.arange(len(size)), size), terms.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False)


def nearest(table: pa.Table, k: int, weight: float) -> pa.Table:
    """q, s1 and unrounded cosines of the k entries of best rounded score for each query, ties by id.

    table: entry (or else query), entity_id, term (space and term), w.
    """
    entries, row, term, ws = _vectors(table.filter(table["entry"]))
    queries, of, asked, wq = _vectors(table.filter(pc.invert(table["entry"])))
    code, known = pd.factorize(term)
    named = np.fromiter((x[0] == "n" for x in known), bool, len(known))
    by = np.argsort(code, kind="stable")
    row, ws, size = row[by], ws[by], np.bincount(code, minlength=len(known))
    begin = np.cumsum(size) - size
    code = pd.Index(known).get_indexer(asked) if len(known) else np.full(len(asked), -1)
    of, wq, code = (x[code >= 0] for x in (of, wq, code))
    wide = -(-max(1, len(entries)) // STRIDE) * STRIDE
    step = max(1, CELLS // wide)
    at = np.searchsorted(of, np.arange(0, len(queries) + step, step))
    out: list[tuple] = []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if a == b:
            continue
        c, r, x = code[a:b], of[a:b] - i * step, wq[a:b]
        cos = []
        for space in (named[c], ~named[c]):
            n = size[c[space]]
            place = np.arange(n.sum()) + np.repeat(begin[c[space]] - (np.cumsum(n) - n), n)
            cos.append(np.bincount(np.repeat(r[space] * wide, n) + row[place], np.repeat(x[space], n) * ws[place], step * wide))
        score = weight * cos[0] + (1 - weight) * cos[1]
        # k stretches reach the k-th largest of their maxima, so the k-th best score is no less
        most = score.reshape(step, wide // STRIDE, STRIDE).max(axis=2)
        least = np.partition(most, -k, axis=1)[:, -k] - SLACK if most.shape[1] > k else np.full(step, -1.0)
        hit = np.flatnonzero(((score.reshape(step, wide) >= least[:, None]).ravel()) & ((cos[0] > 0) | (cos[1] > 0)))
        name, addr = cos[0][hit], cos[1][hit]
        rounded = half_up(weight * half_up(name) + (1 - weight) * half_up(addr))
        q, s = hit // wide, hit % wide
        order = np.lexsort((s, -rounded, q))
        first = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - first < k]
        out.append((q[order] + i * step, s[order], name[order], addr[order]))
    q, s, name, addr = (np.concatenate(x) for x in zip(*out)) if out else ([np.array([], np.int64)] * 2 + [np.array([], np.float64)] * 2)
    return pa.table({"q": queries.take(pa.array(q)), "s1": entries.take(pa.array(s)), "name_cos": name, "addr_cos": addr})

"""Byte-level BPE in numpy: encoding, decoding, and whole-token counting.

Pre-tokens of similar length form a padded matrix, a row each.  In every round every row merges its leftmost pair of
minimum rank; rows that have none leave, the others shrink by one column.  The ranks of
neighbouring pairs are kept beside the tokens, so a round looks up two pairs a row, in an
open-addressing hash table.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import chunks, small_batches, texts

NONE = np.int32(2**31 - 1)
#: Rows longer than this are merged with a heap, in L log L instead of L * L.
LONGEST_ROW = 2048
#: Pre-tokens a worker remembers.
REMEMBERED = 250_000
#: Characters of text that are split before their new pre-tokens are merged together.
AT_ONCE = 3_000_000
#: Cells of one matrix.
CELLS = 1 << 20


class Pairs:
    """Hash table (left id, right id) -> rank, with the id that a rank yields."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        self.result = result.astype(np.int32)
        self.bits = max(4, int(3 * len(left)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key = left.astype(np.int64) << 24 | right
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several for one slot, one stays
            won = self.keys[slot] == key
            self.ranks[slot[won]] = rank[won]
            key, rank, slot = key[~won], rank[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where there is no such pair; ids below 0 are padding."""
        key = left.astype(np.int64) << 24 | right
        key[(left < 0) | (right < 0)] = -2
        slot, out = self._slot(key), np.full(len(key), NONE, np.int32)
        at = np.arange(len(key))
        while len(at):
            found = self.keys[slot]
            hit = found == key
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != -1) & (key != -2)
            at, key, slot = at[go], key[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows laid end to end (ids, and how many each has) after all their merges, laid out alike."""
        begin = np.cumsum(sizes) - sizes
        order, done, at = np.argsort(sizes, kind="stable"), [], 0
        ordered = sizes[order]
        while at < len(order):
            least = max(1, int(ordered[at]))
            if least > LONGEST_ROW:
                for i in order[at:]:
                    row = self._long(ids[begin[i] : begin[i] + sizes[i]])
                    done.append((np.array([i]), np.array([len(row)]), row))
                break
            # a bucket: lengths within a quarter of the least
            most = least + least // 4
            end = min(int(np.searchsorted(ordered, most, "right")), at + max(1, CELLS // most))
            rows = order[at:end]
            m = np.full((len(rows), max(2, most)), -1, np.int32)
            places = np.repeat(begin[rows], sizes[rows]) + _within(sizes[rows])
            m[np.arange(m.shape[1]) < sizes[rows, None]] = ids[places]
            done += self._matrix(m, rows)
            at = end
        counts = np.zeros(len(sizes), np.int64)
        for rows, n, _ in done:
            counts[rows] = n
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for rows, n, row_ids in done:
            out[np.repeat(begin[rows], n) + _within(n)] = row_ids
        return out, counts

    def _matrix(self, m: np.ndarray, rows: np.ndarray) -> list:
        """(rows, counts, ids) of what each round finishes."""
        ranks, out = self.rank(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1), []
        while len(m):
            i = np.arange(len(m))
            j = ranks.argmin(axis=1)
            best = ranks[i, j]
            go = best != NONE
            if not go.all():
                ended = m[~go]
                held = ended >= 0
                out.append((rows[~go], held.sum(axis=1), ended[held]))
                m, ranks, rows, j, best = m[go], ranks[go], rows[go], j[go], best[go]
                i = np.arange(len(m))
            if not len(m):
                break
            width = m.shape[1]
            m[i, j] = self.result[best]
            keep = np.ones(m.shape, bool)
            keep[i, j + 1] = False
            m = m[keep].reshape(len(m), width - 1)
            if width == 2:
                out.append((rows, np.ones(len(m), np.int64), m[:, 0]))
                break
            keep = np.ones(ranks.shape, bool)
            keep[i, j] = False
            ranks = ranks[keep].reshape(len(m), width - 2)
            left, right = j > 0, j < width - 2
            x, y = np.r_[i[left], i[right]], np.r_[j[left] - 1, j[right]]
            ranks[x, y] = self.rank(m[x, y], m[x, y + 1])
        return out

    def _long(self, row: np.ndarray) -> np.ndarray:
        """Leftmost least pair first, by a heap over a linked list."""
        ids, n = row.tolist(), len(row)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(row[:-1], row[1:])
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        live = [True] * n
        table = functools.lru_cache(1 << 16)(lambda a, b: int(self.rank(np.array([a]), np.array([b]))[0]))
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            k = after[i] if live[i] else n
            if k >= n or ids[i] != a or ids[k] != b:
                continue
            ids[i], live[k] = int(self.result[rank]), False
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := table(ids[x], ids[y])) != NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([t for t, ok in zip(ids, live) if ok], np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the stretches of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Encoder:
    """A vocabulary of byte strings with its merges; splits text by a pattern."""

    def __init__(self, vocab: dict[bytes, int], pairs: Pairs, pattern: str, whole: dict[str, tuple]):
        self.vocab, self.pairs, self.find = vocab, pairs, regex.compile(pattern).findall
        self.byte = np.array([vocab.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.whole, self.known = whole, dict(whole)
        self.bytes_of = {i: b for b, i in vocab.items()}
        #: One object for each id: what is remembered shares them.
        self.ints = np.array(range(max(vocab.values()) + 1), object)

    def learn(self, words: set[str]) -> None:
        """Merge the pre-tokens that aren't known yet."""
        if len(self.known) > REMEMBERED:
            self.known = self.whole | {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known]
        rows, ends = self.merged([w.encode() for w in new])
        self.known |= {w: tuple(rows[a:b]) for w, a, b in zip(new, [0, *ends], ends)}

    def merged(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Ids of all words end to end, and where each ends."""
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        out, counts = self.pairs.merge(ids, np.fromiter(map(len, words), np.int64, len(words)))
        return self.ints[out].tolist(), np.cumsum(counts).tolist()

    def encode(self, data: list[str]) -> list[list[int]]:
        words = [self.find(x) for x in data]
        self.learn(set(itertools.chain.from_iterable(words)))
        of = self.known.__getitem__
        return [list(itertools.chain.from_iterable(map(of, w))) for w in words]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(4)
def rank_encoder(path: str, pattern: str) -> Encoder:
    """From a rank file (base64 token, rank a line): two neighbours merge if their bytes together are a token."""
    vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    found = [(vocab[t[:i]], vocab[t[i:]], r) for t, r in vocab.items() for i in range(1, len(t)) if t[:i] in vocab and t[i:] in vocab]
    left, right, rank = np.array(found, np.int64).T
    # the pre-tokens that are tokens themselves are taken whole
    whole = {}
    for t, r in vocab.items():
        try:
            whole[t.decode()] = (r,)
        except UnicodeDecodeError:
            continue
    return Encoder(vocab, Pairs(left, right, rank, np.arange(max(vocab.values()) + 1)), pattern, whole)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def merge_encoder(path: str, pattern: str) -> tuple[Encoder, list[str]]:
    """From a tokenizers file of byte-level BPE, and its added tokens.

    Every vocabulary string is merged alone, once; those that end as one token are the proven shortcut.
    """
    spec = json.load(open(path, encoding="utf-8"))
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    added = [t["content"] for t in spec["added_tokens"]]
    vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    sides = [(vocab[raw(a)], vocab[raw(b)], vocab[raw(a + b)]) for a, b in merges]
    left, right, result = np.array(sides, np.int64).T
    encoder = Encoder(vocab, Pairs(left, right, np.arange(len(sides)), result), pattern, {})
    names = list(vocab)
    rows, ends = encoder.merged(names)
    for t, a, b in zip(names, [0, *ends], ends):
        if b - a == 1:
            try:
                encoder.whole[t.decode()] = (rows[a],)
            except UnicodeDecodeError:
                continue
    encoder.known = dict(encoder.whole)
    return encoder, added


def bpe_round_trip(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded (binary: the ids' bytes) of whole texts.

    Null texts are empty: no ids.  A row in gives a row out, in any order; doc_id may be null or
    repeat.  Other columns are ignored.  path is a rank file that every executor can open.
    """
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = rank_encoder(path, pattern)
        for batch in batches:
            data = [x.decode() for x in texts(batch)]
            ids = []
            for part in chunks(data, AT_ONCE):
                ids += encoder.encode(data[part.start : part.stop])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([np.array(x, np.int32) for x in ids], pa.list_(pa.int32())), pa.array(map(encoder.decode, ids), pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded binary")


def id_digest(ids: str = "ids"):
    """SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def token_counts(spark: SparkSession, docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of whole texts.

    Pre-tokens that the vocabulary proves to be one token count as one; the rest are merged, once for
    each distinct one.  An added token's string in a text is that token.  Null texts are empty: 0.
    """
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, added = merge_encoder(path, pattern)
        cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        for batch in batches:
            raw, counts = texts(batch), []
            for part in chunks(raw, AT_ONCE):
                parts = [cut.split(x.decode()) if cut else [x.decode()] for x in raw[part.start : part.stop]]
                words = [list(itertools.chain.from_iterable(map(encoder.find, p))) for p in parts]
                rest = [[w for w in x if w not in encoder.whole] for x in words]
                encoder.learn(set(itertools.chain.from_iterable(rest)))
                counts += [len(p) - 1 + len(x) - len(r) + sum(map(len, map(encoder.known.__getitem__, r))) for p, x, r in zip(parts, words, rest)]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), n, pa.array([c > limit for c in counts])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

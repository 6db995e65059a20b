"""String similarities: Levenshtein on the JVM, the others as Arrow-batched UDFs over kernels that take many pairs at once."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinmatch import config as C

#: Pairs that are compared in one go; rows of windows in one go.
PAIRS, WINDOWS = 4096, 512
#: Longest text that fits a machine word.
WORD = 64


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix padded with 0, and lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out, size


def places(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For every place of b the places of a (64 at most) with the same character, as bits; none beyond b's size."""
    out = np.zeros(b.shape, np.uint64)
    equal = np.zeros((len(a), WORD), bool)
    for j in range(b.shape[1]):
        equal[:, : a.shape[1]] = a == b[:, j : j + 1]
        out[:, j] = np.packbits(equal, axis=1, bitorder="little").view("<u8")[:, 0]
    out[np.arange(b.shape[1]) >= size[:, None]] = 0
    return out


def full(size: np.ndarray) -> np.ndarray:
    """So many low bits."""
    n = size.astype(np.uint64)
    return np.where(n >= WORD, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def common_long(a: str, b: str) -> int:
    """Length of the longest common subsequence of texts of any length, bit-parallel over a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair: bit-parallel over the shorter text, a place of all longer ones at a time."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    fits = [i for i in order if 0 < len(pairs[i][0]) <= WORD]
    for at in range(0, len(fits), PAIRS):
        part = fits[at : at + PAIRS]
        x, n = codes([pairs[i][0] for i in part])
        y, m = codes([pairs[i][1] for i in part])
        every, hits = full(n), places(x, y, m)
        row = every.copy()
        for j in range(y.shape[1]):
            hit = row & hits[:, j]
            row = (row + hit | row - hit) & every
        out[part] = n - np.bitwise_count(row)
    for i in order:
        if len(pairs[i][0]) > WORD:
            out[i] = common_long(*pairs[i])
    return out


def ratio(a: list[str], b: list[str]) -> np.ndarray:
    """0..100: twice the common subsequence over both lengths."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    return np.where(total > 0, 200.0 * common(a, b) / np.maximum(total, 1), 100.0)


def token_sort(a: list[str], b: list[str]) -> np.ndarray:
    tidy = lambda s: [" ".join(sorted(x.split())) for x in s]
    return ratio(tidy(a), tidy(b))


def token_set(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio among the shared words, and the shared with the rest of either; 100 if one has no rest, 0 if one has no words."""
    out, one, two, shared = np.zeros(len(a)), [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = set(x.split()), set(y.split())
        both = " ".join(sorted(x & y))
        if x and y and both and (x <= y or y <= x):
            out[i] = 100.0
        elif x and y:
            one.append(f"{both} {' '.join(sorted(x - y))}".strip())
            two.append(f"{both} {' '.join(sorted(y - x))}".strip())
            shared.append((i, len(both)))
    if shared:
        best = ratio(one, two)
        for (i, n), r, x, y in zip(shared, best.tolist(), one, two):
            # the shared words are the beginning of either
            out[i] = max(r, 200.0 * n / (n + len(x)), 200.0 * n / (n + len(y))) if n else r
    return out


def _stretches(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Best ratio of x and any stretch of y of at most x's length, for x of 64 characters at most."""
    most, reach = x.shape[1], y.shape[1]
    # a column for each start, from 1 - most on; a stretch of a shorter x is cut by time
    hits = np.zeros((len(x), most - 1 + reach + most), np.uint64)
    hits[:, most - 1 : most - 1 + reach] = places(x, y, m)
    starts = np.arange(1 - most, reach)
    every = full(n)[:, None]
    row = np.broadcast_to(every, (len(x), len(starts))).copy()
    for t in range(most):
        hit = row & np.where((t < n)[:, None], hits[:, t : t + len(starts)], np.uint64(0))
        row = (row + hit | row - hit) & every
    lcs = n[:, None] - np.bitwise_count(row).astype(np.int64)
    size = np.minimum(m[:, None], starts + n[:, None]) - np.maximum(0, starts)
    return (np.where(size > 0, 200.0 * lcs, 0.0) / np.maximum(n[:, None] + size, 1)).max(axis=1)


def partial(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter text and any stretch of the longer of at most its length; of equal lengths, both ways."""
    out, some = np.zeros(len(a)), []
    for i, (x, y) in enumerate(zip(a, b)):
        if len(x) > len(y):
            x, y = y, x
        if not x:
            out[i] = 0.0 if y else 100.0
        elif x in y:
            out[i] = 100.0
        else:
            some.append((len(x), len(y), i, x, y))
            if len(x) == len(y):
                some.append((len(x), len(y), i, y, x))
    some.sort(key=lambda s: s[:3])
    fits = [s for s in some if s[0] <= WORD]
    for at in range(0, len(fits), WINDOWS):
        part = fits[at : at + WINDOWS]
        found = _stretches(*codes([s[3] for s in part]), *codes([s[4] for s in part]))
        np.maximum.at(out, [s[2] for s in part], found)
    for n, m, i, x, y in some[len(fits) :]:
        cuts = list({y[max(0, s) : s + n] for s in range(1 - n, m)})
        out[i] = max(out[i], float(ratio([x] * len(cuts), cuts).max()))
    return out


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """0..1, prefix weight 0.1 over four characters at most."""
    out = np.zeros(len(a))
    order = sorted(range(len(a)), key=lambda i: len(a[i]) + len(b[i]))
    for at in range(0, len(order), PAIRS):
        part = np.array(order[at : at + PAIRS])
        (x, n), (y, m) = codes([a[i] for i in part]), codes([b[i] for i in part])
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)[:, None]
        place, rows = np.arange(y.shape[1]), np.arange(len(part))
        used_x, used_y = np.zeros(x.shape, bool), np.broadcast_to(place >= m[:, None], y.shape).copy()
        beyond = used_y.copy()
        for i in range(x.shape[1]):
            can = (y == x[:, i : i + 1]) & ~used_y & (np.abs(place - i) <= reach) & (i < n)[:, None]
            j = can.argmax(axis=1)
            hit = can[rows, j]
            used_x[hit, i], used_y[rows[hit], j[hit]] = True, True
        used_y &= ~beyond
        hits = used_x.sum(axis=1)
        pick = lambda s, u: np.take_along_axis(s, np.argsort(~u, axis=1, kind="stable"), 1)
        first, second = pick(x, used_x), pick(y, used_y)
        width = min(x.shape[1], y.shape[1])
        turned = ((first[:, :width] != second[:, :width]) & (np.arange(width) < hits[:, None])).sum(axis=1) // 2
        k = np.maximum(hits, 1)
        jaro = np.where(hits > 0, (hits / np.maximum(n, 1) + hits / np.maximum(m, 1) + (hits - turned) / k) / 3, 0.0)
        width = min(4, x.shape[1], y.shape[1])
        alike = (x[:, :width] == y[:, :width]) & (np.arange(width) < np.minimum(n, m)[:, None])
        prefix = np.minimum.accumulate(alike, axis=1).sum(axis=1)
        jaro = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
        out[part] = np.where((n == 0) & (m == 0), 1.0, jaro)
    return out


KERNELS = {"ratio": ratio, "token_sort": token_sort, "token_set": token_set, "partial": partial, "jaro_winkler": jaro_winkler}


@functools.cache
def _udf(name: str):
    kernel = KERNELS[name]

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        at = {pair: i for i, pair in enumerate(dict.fromkeys(p for p in zip(a, b) if p[0] is not None and p[1] is not None))}
        found = kernel([p[0] for p in at], [p[1] for p in at]).tolist() if at else []
        return pd.Series([found[at[p]] if p in at else None for p in zip(a, b)], dtype="float64")

    return run


def similarity(name: str, a: Column, b: Column) -> Column:
    """0..1 by a kernel; a null side gives null.  Equal pairs in a batch are computed once."""
    return _udf(name)(a, b) / (1.0 if name == "jaro_winkler" else 100.0)


#: Names of letters that the rule below would get wrong.
_NAMED = {"ie": "e", "ghe": "g"}
_VOWELS = re.compile("[aeiouy]+")
_CLUSTER = re.compile("[^aeiouy]+")


def _spoken(name: str) -> str:
    """A letter of another script, from its name: KA is k, SHCHA shch, EM m, ALPHA a, AA aa."""
    word = name.rsplit(" ", 1)[-1].lower()
    if "HIRAGANA" in name or "KATAKANA" in name or word in _NAMED or _VOWELS.fullmatch(word):
        return _NAMED.get(word, word)
    if m := _CLUSTER.match(word):
        return m[0]
    return word[1:] if word[0] == "e" and _CLUSTER.fullmatch(word[1:]) else word[0]


@functools.lru_cache(1 << 16)
def _ascii_letter(c: str) -> str:
    out = []
    for x in unicodedata.normalize("NFKD", C.LATIN_DOUBLE.get(c) or C.LATIN.get(c, c)):
        name = unicodedata.name(x, "")
        if ord(x) < 128:
            out.append(x)
        elif unicodedata.combining(x) or name.endswith(("SOFT SIGN", "HARD SIGN")):
            continue
        elif " LETTER " in name or " VOWEL SIGN " in name:
            out.append(_spoken(name))
        else:
            out.append(" ")
    return "".join(out)


def to_ascii(s: str) -> str:
    """ASCII for any script, by decomposition and by the names of letters; other characters become blanks."""
    return s if s.isascii() else "".join(map(_ascii_letter, s))


@F.pandas_udf(StringType())
def transliterate(s: pd.Series) -> pd.Series:
    """ASCII for any script; ASCII texts pass as they are."""
    return s.map(lambda x: None if x is None else to_ascii(x))

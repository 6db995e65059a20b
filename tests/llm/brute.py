"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substrings(docs, length):
    """doc_id -> (words, kept words); docs: (doc_id, text), ids unique."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for a in range(len(words) - length + 1):
            w = tuple(words[a : a + length])
            if w in seen:
                gone[a : a + length] = [True] * length
            seen.add(w)
        out[i] = (words, [w for w, g in zip(words, gone) if not g])
    return out


def repeats(docs, length):
    """doc_id -> (bytes, mask of removed bytes)."""
    at = defaultdict(list)
    data = {i: (text or "").encode() for i, text in docs}
    for i, x in data.items():
        for a in range(len(x) - length + 1):
            at[x[a : a + length]].append((i, a))
    mask = {i: [False] * len(x) for i, x in data.items()}
    for places in at.values():
        if len(places) > 1:
            for i, a in places:
                mask[i][a : a + length] = [True] * length
    return {i: (data[i], mask[i]) for i in data}


def classes(n, linked):
    """Least member of each component, by union-find."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]

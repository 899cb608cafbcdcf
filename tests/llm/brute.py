"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re

import regex


def repeats(docs, span=50):
    """{row index: sorted byte positions} covered by strings that a document with a smaller id has; docs are (id, text)."""
    rank = [(i is None, i or 0) for i, _ in docs]
    first = {}
    for r, (_, t) in zip(rank, docs, strict=True):
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            s = b[k:k + span]
            if s not in first or r < first[s]:
                first[s] = r
    out = []
    for r, (_, t) in zip(rank, docs, strict=True):
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - span + 1):
            if first[b[k:k + span]] < r:
                gone.update(range(k, k + span))
        out.append(gone)
    return out


def suffix_digest(docs):
    out = []
    for (i, t), gone in zip(docs, repeats(docs), strict=True):
        b = (t or "").encode()
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    return out


def without_repeats(docs):
    """Texts less the repeated characters: those all of whose bytes are covered."""
    out = []
    for (i, t), gone in zip(docs, repeats(docs), strict=True):
        text, at = [], 0
        for ch in t or "":
            n = len(ch.encode())
            if not all(k in gone for k in range(at, at + n)):
                text.append(ch)
            at += n
        out.append((i, None if t is None else "".join(text)))
    return out


def shingle_set(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_groups(docs, n, num, den):
    """{id: component}; docs are (id, text); rows without id are left out."""
    s = [(i, shingle_set(t, n)) for i, t in docs if i is not None]
    up = {i: i for i, _ in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for (a, x), (b, y) in itertools.combinations(s, 2):
        both = len(x & y)
        if x and y and den * both >= num * (len(x) + len(y) - both):
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    return {i: top(i) for i in up}


def leaks(docs, items, words=5):
    """{(doc id, item id)} with at least 4/5 of the item's shingles in the document; an item of fewer words is one shingle."""
    def split(t):
        return [x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]

    def runs(w, n):
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    i = {}
    for k, t in items:
        w = split(t)
        if w:
            i.setdefault(k, set()).update(runs(w, min(len(w), words)))
    lengths = {len(g) for x in i.values() for g in x}
    d = {}
    for k, t in docs:
        w = split(t)
        d.setdefault(k, set()).update(*[runs(w, n) for n in lengths])
    return {(a, b) for a, x in d.items() for b, y in i.items() if y and 5 * len(x & y) >= 4 * len(y)}

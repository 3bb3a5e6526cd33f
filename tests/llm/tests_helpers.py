"""Brute force that several tests share."""

import re
from collections import defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def covered(texts, size=50):
    """doc: (word positions that stand in another document, those that stand in one of a smaller id)."""
    words = {k: WORD.findall(t or "") for k, t in texts.items()}
    where = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - size + 1):
            where[tuple(w[i : i + size])].add(k)
    out = {}
    for k, w in words.items():
        every, low = set(), set()
        for i in range(len(w) - size + 1):
            at = where[tuple(w[i : i + size])]
            if len(at) > 1:
                every.update(range(i, i + size))
                if min(at) < k:
                    low.update(range(i, i + size))
        if every:
            out[k] = every, low
    return out


def shingles(t, n=4):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(texts, threshold=Fraction(85, 100), n=4):
    sets = {k: shingles(t, n) for k, t in texts.items()}
    ids = sorted(sets)
    label = {k: k for k in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                both = len(x & y)
                if both >= threshold * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    label[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k)) for k in ids}

"""Plain restatements of the contracts, for small inputs."""

import hashlib
from collections import defaultdict

BLANKS = b" \t\n\x0b\x0c\r"


def ascii_lower(b: bytes) -> bytes:
    return b.lower()


def shingles(text, k):
    words = ascii_lower((text or "").encode()).split()
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_duplicates(rows, k, percent=80):
    """rows: (doc_id, text) -> {doc_id: (n, component)}"""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1 :]}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def line_key(line):
    return ascii_lower(line.encode().strip(BLANKS)).decode()


def dedup_lines(rows, min_chars=10):
    first, last = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line_key(line)
            first[key] = min(first.get(key, i), i)
            last[key] = max(last.get(key, i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < min_chars or first[line_key(x)] == last[line_key(x)] or first[line_key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out

"""Slow and plain versions of the operators, by their contracts."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t or ""), []).append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t or "")]
        ids = [x for x in own if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(own), i == keep, sha(lower(t or ""))))
    return out


def lines(rows, least=20, docs=3):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held.setdefault(key(x), set()).add(i)
    rank = lambda i: -1 if i is None else i
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = [len(held.get(key(x), ())) >= docs and rank(i) < max(map(rank, held[key(x)])) for x in own]
        out.append((i, len(own), sum(gone), sha("\n".join(x for x, g in zip(own, gone) if not g))))
    return out


def windows(rows, n=13):
    first = {}
    rank = lambda i: 2**63 if i is None else i
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            first[s] = min(first.get(s, 2**64), rank(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < rank(i):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def repeats(rows, n=200):
    count = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for k in range(len(b) - n + 1):
            count[b[k : k + n]] = count.get(b[k : k + n], 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(t, n=5):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(rows):
    """Rows without null ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, u) = sets[a], sets[b]
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), i == find(i)) for i, s in sets]


def crc_fold(i, n):
    return zlib.crc32(str(i).encode()) % n

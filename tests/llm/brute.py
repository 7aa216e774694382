"""Brute-force versions of the operators, on plain Python rows."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, rx=SPACED):
    return rx.findall((text or "").encode().lower())


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


class Groups:
    def __init__(self):
        self.up = {}

    def root(self, i):
        self.up.setdefault(i, i)
        while self.up[i] != i:
            i = self.up[i]
        return i

    def tie(self, i, j):
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(rows, k, percent):
    """rows: (doc_id, text) -> {(doc_id, text): (set size, component, kept)}"""
    sets = [(i, t, shingle_set(t, k)) for i, t in rows]
    g = Groups()
    for a, (i, _, s) in enumerate(sets):
        for j, _, u in sets[:a]:
            if i is None or j is None or not s or not u:
                continue
            if 100 * len(s & u) >= percent * len(s | u):
                g.tie(i, j)
    return {(i, t): (len(s), None if i is None else g.root(i), i is None or g.root(i) == i) for i, t, s in sets}


def repeats(rows, length=400):
    """[(n_bytes, n_removed, n_spans, sha256 of the rest)] in row order."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def without_long_repeats(rows, length, words):
    """Texts without the runs of repeated strings that hold more than `words` whole words."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, int)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p + 1:p + length + 1] = 1
        edge = np.flatnonzero(np.diff(gone))
        keep, at = [], 0
        for s, e in edge.reshape(-1, 2).tolist():
            whole = [m for m in SPACED.finditer(b) if s <= m.start() and m.end() <= e]
            if len(whole) > words:
                keep.append(b[at:s])
                at = e
        out.append("".join(k.decode("utf-8", "ignore") for k in [*keep, b[at:]]))
    return out


def contamination(docs, items, window=10):
    """[(n_words, n_hit, items, sha)] in row order."""
    pats = {}
    for i, t in items:
        w = words(t, ALNUM)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            pats.setdefault(tuple(w[a:a + n]), set()).add("" if i is None else str(i))
    sizes = {len(p) for p in pats}
    out = []
    for _, t in docs:
        w = words(t, ALNUM)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                x = pats.get(tuple(w[a:a + n]))
                if x:
                    hit |= set(range(a, a + n))
                    found |= x
        names = sorted(found)
        out.append((len(w), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest()))
    return out


def unigram(rows, mod=10):
    """{(doc_id, text): (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    def crc(i):
        return 0 if i is None else zlib.crc32(str(i).encode())
    toks = [(i, t, [*words(t), None]) for i, t in rows]
    c = Counter(w for i, _, ws in toks if crc(i) % mod for w in ws)
    n, v = sum(c.values()), len(c)
    return {(i, t): (crc(i) % mod == 0, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, t, ws in toks}


def vector_links(rows, limit):
    """rows: (vec_id, vector, label) -> [(n_links)] in row order and components."""
    good = []
    for i, x, lab in rows:
        ok = i is not None and lab is not None and x is not None and all(v is not None and math.isfinite(v) for v in x) and any(v != 0 for v in x)
        good.append(np.array(x, float) / np.linalg.norm(np.array(x, float)) if ok else None)
    g, n = Groups(), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if good[a] is None or good[b] is None or rows[a][2] != rows[b][2] or len(good[a]) != len(good[b]):
                continue
            if good[a] @ good[b] >= limit:
                n[a] += 1
                n[b] += 1
                g.tie(rows[a][0], rows[b][0])
    return n, [None if r[0] is None else g.root(r[0]) for r in rows]


def targets(sizes, weights=(5, 2, 1), share=1.5, hold=2):
    """sizes: {source: words} -> {source: target} by repeated resharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        t = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * t > hold * sizes[s]}
        if not over:
            out |= {s: w[s] * t for s in open_}
            break
        for s in over:
            out[s] = float(hold * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def sainte_lague(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * got[j] + 1), -j))
        got[i] += 1
    return got

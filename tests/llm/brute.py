"""Plain versions of the operators, on lists."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash


def repeats(rows, k=20):
    """rows: (doc_id, text), ids distinct. (doc_id, n_words, n_removed, sha256 of kept words)."""
    first, docs = {}, [(d, (t or "").encode().split()) for d, t in sorted(rows)]
    for d, w in docs:
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (d, i))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] != (d, i):
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, size=4, seed=42):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, distance=4):
    """rows: (doc_id, fingerprint). {doc_id: smallest reachable id}, over all pairs."""
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= distance:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d, _ in rows}


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """sizes: {source: words}. Shares by weight, those above their cap cut, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = float(most * sizes[s])
            free.remove(s)
        left -= sum(out[s] for s in over)
    return out


def edited(rows):
    """rows: (doc_id, text), ids distinct. {doc_id: (text, edited text, next id)} in descending order of ids."""
    order, out = sorted(rows, reverse=True), {}
    for k, (d, t) in enumerate(order):
        n = order[(k + 1) % len(order)]
        half = len(t or "") // 2
        out[d] = (t or "", (t or "")[: len(t or "") - half] + (n[1] or "")[:half], n[0])
    return out


def likeness(a, b, whole=True):
    """Share of the longer text in spans that both have, compared as texts. Only the cut points are the operator's."""
    from chronoplane.llm.prefix_hash import cuts

    if a == b:
        return 1.0
    found = [cuts(np.array(list(map(ord, t)), np.uint32)) for t in (a, b)]
    bound = min(f[2] for f in found)
    parts = []
    for t, (at, marks, _) in zip((a, b), found, strict=True):
        edges = [0, *[i for i, x in zip(at.tolist(), marks.tolist(), strict=True) if x < bound], len(t)]
        parts.append([t[i:j] for i, j in zip(edges, edges[1:], strict=False)])
    xs, ys = parts
    match, last = {}, -1
    for i, x in enumerate(xs):
        free = [j for j, y in enumerate(ys) if y == x and j not in match.values()]
        if free:
            last = match[i] = last + 1 if last + 1 in free else free[0]
    total, rest = sum(len(xs[i]) for i in match), [len(y) for y in ys]
    for i, x in enumerate(xs if whole else []):
        if i in match:
            continue
        left = len(x)
        for j, back in ((match.get(i - 1, -2) + 1 if i else 0, False), (match.get(i + 1, -2) - 1 if i + 1 < len(xs) else len(ys) - 1, True)):
            if 0 <= j < len(ys) and j not in match.values():
                pair = (x[::-1], ys[j][::-1]) if back else (x, ys[j])
                equal = next((k for k, (p, q) in enumerate(zip(*pair, strict=False)) if p != q), min(map(len, pair)))
                gain = min(left, rest[j], equal)
                left, rest[j], total = left - gain, rest[j] - gain, total + gain
    return total / max(len(a), len(b))


def similar(texts, size=5, percent=80):
    """texts: {id: text}. {id: smallest reachable id}, over all pairs of sets of shingles."""

    def shingles(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in order}

"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(lower(text))
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def near_components(docs):
    """{id: (set size, component)} of {id: text}."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def secrets(text):
    """(start, kind, end) of the base findings."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def secrets_sha(text):
    names = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in secrets(text)).encode()).hexdigest()


def repeats_removed(docs, width=100):
    """{id: (bytes, removed, spans, sha of the rest)} of {id: text}."""
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s:s + width] in seen:
                gone[s:s + width] = b"\1" * width
            else:
                seen.add(b[s:s + width])
        left = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def quality(text, least=10):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered, longest)."""
    text = text or ""
    w = words(text)
    n = len(w)
    lines = [x for x in text.split("\n") if words(x)]

    def covered(size):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(w[i:i + size]), []).append(i)
        mark = np.zeros(n, bool)
        for at in places.values():
            if len(at) > 1:
                for i in at:
                    mark[i:i + size] = True
        return mark

    longest, span = 0, np.zeros(n, bool)
    for size in range(least, n):
        m = covered(size)
        if not m.any():
            break
        longest, span = size, span | m
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            int(covered(3).sum()), int(span.sum()), longest)


def quality_kept(text):
    n, _, _, _, again, span, longest = quality(text)
    return n >= 50 and 100 * again <= 50 * n and 100 * span <= 20 * n and longest <= 100


def contaminated(text, items, window=13, misses=2):
    """Ids of the items of which ``window`` aligned words stand in the text."""
    w, found = words((text or "").lower()), set()
    for item, t in items.items():
        q = words((t or "").lower())
        if not q:
            continue
        size, need = (window, window - misses) if len(q) >= window else (len(q), len(q))
        if sum((Counter(w) & Counter(q)).values()) < need:      # equal places are equal words
            continue
        for i in range(len(w) - size + 1):
            for j in range(len(q) - size + 1):
                if sum(a == b for a, b in zip(w[i:i + size], q[j:j + size])) >= need:
                    found.add(item)
    return found


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target} by capping until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, goal = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = goal - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def minimax(sizes, n):
    """Smallest possible largest sum over contiguous cuts into at most n parts."""
    pre = np.concatenate([[0], np.cumsum(sizes)])
    best = pre.astype(float).copy()
    for _ in range(n - 1):
        best = np.array([0.0] + [min(max(best[j], pre[i] - pre[j]) for j in range(i)) for i in range(1, len(pre))])
    return int(best[-1])

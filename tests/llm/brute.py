"""Plain forms of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_groups(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids, holders = sorted(sets), {}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for i in ids:
        for j, n in Counter(j for s in sets[i] for j in holders[s] if j > i).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed(rows, length):
    """(doc, bytes, removed, spans, sha256 of the rest); rows of one id and text are one
    place, and different texts of one id come in the order of their hashes."""
    seen, out = {}, []
    rows = [(d, (t or "").encode()) for d, t in rows]
    for d, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest(r[1], 42) + 2**63) % 2**64)):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], (d, b, i)) != (d, b, i):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(docs, items, window=10):
    out = []
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    lengths = {len(k) for k in windows}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    found |= windows[k]
                    hit[a : a + n] = [True] * n
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]

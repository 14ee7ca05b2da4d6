"""Plain-Python forms of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UP, LOW)


def lower(t):
    return (t or "").translate(_LOWER)


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, n, percent=80):
    """{doc_id: (n_shingles, component)} of [(doc_id, text)]."""
    sets = {i: shingles(t, n) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    part = components(sets, links)
    return {i: (len(sets[i]), part[i]) for i in sets}


def keys_of(t):
    return [lower(x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")]


def line_dedup(docs):
    """{doc_id: (n_lines, n_dropped, text)}."""
    held = {}
    for i, t in docs:
        for k in keys_of(t):
            if len(k) >= 10:
                held.setdefault(k, set()).add(i)
    out = {}
    for i, t in docs:
        lines, keys = (t or "").split("\n"), keys_of(t)
        gone = [len(k) >= 10 and min(held[k]) != i for k in keys]
        out[i] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, items)}."""
    windows = {}
    for i, t in items:
        w = bench_words(t)
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    found |= got
        out[i] = (len(w), len(hit), sorted(found))
    return out


def crc_fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def largest_share(docs, items):
    """{doc_id: largest share of the different windows of one item that are in the text}."""
    sets = []
    for _, t in items:
        w = bench_words(t)
        n = min(8, len(w))
        if n:
            sets.append((n, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}))
    out = {}
    for i, t in docs:
        w = bench_words(t)
        held = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n, _ in sets}
        out[i] = max((len(own & held[n]) / len(own) for n, own in sets), default=0.0)
    return out

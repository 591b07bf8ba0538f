"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(rows, n, percent):
    """{doc_id: component} of (doc_id, text) rows with distinct ids."""
    sets, parent = {i: shingle_set(t, n) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def substring(rows, width=13):
    """{doc_id: (words, kept words)} of (doc_id, text) rows with distinct ids."""
    words, first = {i: WORD.findall(t or "") for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out[i] = (w, [x for k, x in enumerate(w) if k not in gone])
    return out


def mix(rows):
    """[(doc_id, take, size)] copies of (doc_id, text, source) rows with distinct ids."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(size[i] for i in by[s]) for s in by}
    left, free, target = 1.5 * sum(total.values()), set(by), {}
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    out = []
    for s in by:
        wanted, at = int(target[s] + 1e-9), 0
        for i in sorted(by[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            for k in range(2):
                take = max(0, min(size[i], wanted - at - k * total[s]))
                if take:
                    out.append((i, take, size[i]))
            at += size[i]
    return out, target, total

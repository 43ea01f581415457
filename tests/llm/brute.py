"""Plain versions of the operators, for small inputs: loops over whole texts, no Spark."""

import re
from collections import defaultdict

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, k):
    w = SPACE_WORD.findall((text or "").translate(LOW))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def jaccard(rows, k, percent):
    """[(id, n, least id reachable, links)] for rows [(id, text)], by comparing all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    same = defaultdict(int)
    for v in at.values():
        for n, a in enumerate(v):
            for b in v[n + 1:]:
                same[a, b] += 1
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in same.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, len(s), least[find(i)], links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def contamination(rows, items, window):
    """[(id, n_words, n_hit, [item ids as sorted strings])]"""
    grams = defaultdict(set)
    for item, text in items:
        w = ALNUM_WORD.findall((text or "").translate(LOW))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i:i + n])].add(str(item))
    out = []
    for d, text in rows:
        w = ALNUM_WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), sorted(found)))
    return out

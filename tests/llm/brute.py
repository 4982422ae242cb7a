"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text):
    w = BLANK.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """rows: (doc_id, text). [(doc_id, n, component, kept)]; rows without an id stand alone."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), None if i is None else least[find(k)], i is None or least[find(k)] == i) for k, (i, s) in enumerate(sets)]


def repeats(rows):
    first = {}
    for i, t in rows:
        w = BLANK.findall(t or "")
        for k in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w, gone = BLANK.findall(t or ""), set()
        for k in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def contamination(rows, items, window=13):
    grams = {}
    for item, text in items:
        w = ITEM.findall(low(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w and item is not None else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes, out = {len(g) for g in grams}, []
    for i, t in rows:
        w, hit, names = ITEM.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    names |= grams[g]
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def statistics(text):
    t = text or ""
    w = BLANK.findall(t)
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if BLANK.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

"""Plain, slow versions of the operators for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, k=13):
    """docs: (doc_id, text) rows; gives (doc_id, n_words, n_removed, kept_sha256)."""
    big = float("inf")
    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (big if i is None else i):
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone))))
    return out


def common_lines(docs, limit):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    lines = [(t or "").split("\n") for _, t in docs]
    found = Counter(k for x in lines for k in {key(y) for y in x})
    out = []
    for (i, _), x in zip(docs, lines, strict=True):
        kept = [y for y in x if not (key(y) and found[key(y)] >= limit)]
        out.append((i, len(x), len(x) - len(kept), sha("\n".join(kept))))
    return out


def simhash(docs):
    import xxhash

    fps = []
    for _, t in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[p : p + 3]) for p in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    return fps


def components(ids, fps, most=3):
    big = float("inf")
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= most:
                root[find(a)] = find(b)
    low = defaultdict(lambda: big)
    for a, i in enumerate(ids):
        low[find(a)] = min(low[find(a)], big if i is None else i)
    return [low[find(a)] for a in range(len(ids))]


def line_stats(text):
    w = words(text)
    lines = (text or "").split("\n")
    with_word = [x for x in lines if words(x)]
    seen = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
    rep = {q for p in range(len(w) - 7) if seen[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(with_word) - len(set(with_word)), len(rep)

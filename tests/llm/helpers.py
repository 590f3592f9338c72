"""Plain Python versions of the contracts, for comparison on small tables."""
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """``rows`` of (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""
    data = [(r[0], r[1], "xx", r[2] if len(r) > 2 else None, len(r[1] or ""), 7, 0.5, "k") for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "size int, score double, uid string").repartition(3)


def repeated_bytes(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)} by counting every window."""
    data = {d: (t or "").encode() for d, t in rows}
    seen = Counter(b[i:i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(CAPITALS))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(sets, pct):
    """{doc_id: smallest doc_id reachable} over pairs that reach the similarity."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            n = len(x & y)
            if x and y and 100 * n >= pct * (len(x) + len(y) - n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def base_counts(text):
    s = text or ""
    w = WORD.findall(s)
    lines = [x for x in s.split("\n") if WORD.search(x)]
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), len(lines) - len(set(lines)), len(inside)

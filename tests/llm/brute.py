"""Plain versions of the operators, over lists of (id, text)."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def suffix(docs, length=100):
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def windows(docs, length=50):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(docs, size=4, percent=80):
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def contamination(docs, items, size=10):
    runs = {}
    for i, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for s in range(max(1, len(w) - size + 1) if w else 0):
            runs.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    lengths = {len(r) for r in runs}
    out = {}
    for d, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (run := tuple(w[s : s + n])) in runs:
                    hit.update(range(s, s + n))
                    found |= runs[run]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def exact(docs):
    groups = {}
    for d, text in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(d)
    return {d: (min(g), len(g), d == min(g), sha(t)) for t, g in groups.items() for d in g}

"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash


def spans(mask):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return list(zip(edge[::2], edge[1::2]))


def repeats(texts, w):
    """(n_bytes, n_removed, n_spans, kept_sha256) of texts in bytes."""
    count = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), int)
        for i in range(len(t) - w + 1):
            if count[t[i : i + w]] > 1:
                m[i : i + w] = 1
        kept = bytes(np.frombuffer(t, np.uint8)[m == 0])
        out.append((len(t), int(m.sum()), len(spans(m)), hashlib.sha256(kept).hexdigest()))
    return out


def passages(ids, texts, w):
    """(n_words, n_removed, kept_sha256, kept words)."""
    first, words = {}, [t.split() for t in texts]
    for i, x in zip(ids, words):
        if i is not None:
            for k in range(len(x) - w + 1):
                g = tuple(x[k : k + w])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, x in zip(ids, words):
        m = np.zeros(len(x), int)
        for k in range(len(x) - w + 1):
            if i is not None and first[tuple(x[k : k + w])] < i:
                m[k : k + w] = 1
        kept = [a for a, b in zip(x, m) if not b]
        out.append((len(x), int(m.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), kept))
    return out


def simhash(text):
    w = text.lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(ids, prints, bits=3):
    """Smallest id that links reach, for each row."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[find(i)] for i in range(len(ids))]


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")

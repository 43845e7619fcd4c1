"""Plain forms of the operators' contracts, quadratic where that is simplest."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").encode())


def repeated_windows(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) of each (doc_id, text)."""
    split = [(i, words(t)) for i, t in rows]
    first = {}
    for i, w in split:
        for a in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[a : a + window])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, k=5):
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in words(text)]
    return {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()


def linked(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs; equal ids are one document."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is None or j is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return [(i, len(x), None if i is None else root(i)) for i, x in sets]


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def auc(scores, labels):
    """Share of (1, 0) pairs in the right order; ties count half."""
    scores, labels = np.asarray(scores), np.asarray(labels)
    a, b = scores[labels == 1], scores[labels == 0]
    return float(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))


def sequences(pieces):
    """Pieces by sequence, each list in order of offset."""
    out = defaultdict(list)
    for p in pieces:
        out[p["sequence_id"]].append(p)
    return {k: sorted(v, key=lambda p: p["offset"]) for k, v in out.items()}

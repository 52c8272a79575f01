"""Plain, slow versions of what the operators compute."""

import collections
import re
import string
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_classes(docs, at_least=0.8):
    """doc_id -> smallest id of its class, for distinct ids."""
    found = {k: shingles(t) for k, t in docs.items()}
    ids = sorted(found)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if found[a] and found[b] and jaccard(found[a], found[b]) >= at_least]
    return components(ids, links)


def crc(data):
    return zlib.crc32(data)

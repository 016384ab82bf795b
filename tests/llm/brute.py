"""Plain Python versions of the operators' contracts, for small inputs."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = words(lower(text))
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near(rows, width, percent=80):
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    index = {}
    for d in ids:
        for g in sets[d]:
            index.setdefault(g, []).append(d)
    for d in ids:
        common = {}
        for g in sets[d]:
            for o in index[g]:
                if o < d:
                    common[o] = common.get(o, 0) + 1
        for o, c in common.items():
            if 100 * c >= percent * (len(sets[d]) + len(sets[o]) - c):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus

"""Plain versions of the operators, for small tables."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(b: bytes) -> bytes:
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def repeated(texts: list[bytes], n: int = 400) -> list[np.ndarray]:
    """For each text which bytes a string of n bytes covers that also starts anywhere else."""
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                hit[i : i + n] = True
        out.append(hit)
    return out


def repeats_row(text: bytes, hit: np.ndarray) -> tuple:
    kept = bytes(np.frombuffer(text, np.uint8)[~hit])
    spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
    return len(text), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()


def windows(bench: list[tuple], size: int = 10) -> dict[tuple, set[str]]:
    out: dict[tuple, set[str]] = {}
    for item, text in bench:
        w = WORDS.findall(lower((text or "").encode()))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    return out


def contamination(text: bytes, known: dict[tuple, set[str]]) -> tuple[list[int], set[str], list[bytes]]:
    w = WORDS.findall(lower(text))
    hit, items = [0] * len(w), set()
    for n in {len(x) for x in known}:
        for k in range(len(w) - n + 1):
            if found := known.get(tuple(w[k : k + n])):
                items |= found
                hit[k : k + n] = [1] * n
    return hit, items, w


def contamination_row(text: bytes, known: dict) -> tuple:
    hit, items, w = contamination(text, known)
    return len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)


def without_hits(text: bytes, known: dict) -> bytes:
    hit, _, _ = contamination(text, known)
    at = [m.span() for m in WORDS.finditer(lower(text))]
    cover = np.zeros(len(text), bool)
    for i, h in enumerate(hit):
        if h:
            cover[at[i][0] : at[i][1]] = True
            if i + 1 < len(hit) and hit[i + 1]:
                cover[at[i][1] : at[i + 1][0]] = True
    return bytes(np.frombuffer(text, np.uint8)[~cover])


def simhash(text: bytes) -> int:
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps: list[int], distance: int = 4) -> list[int]:
    """The smallest index that each is linked with."""
    root = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
    for i in range(len(root)):
        root[i] = root[root[i]]
    return root

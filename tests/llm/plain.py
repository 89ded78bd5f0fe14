"""Small plain versions the operators are compared with."""

from __future__ import annotations

from itertools import combinations

import xxhash

SPACES = " \t\n\x0b\x0c\r"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(nodes, linked):
    """Smallest reachable node of each node; ``linked`` decides on pairs."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {n: find(n) for n in nodes}


def fingerprint(text: str | None) -> int:
    words, word = [], ""
    for c in ascii_lower(text or "") + " ":
        if c not in SPACES:
            word += c
        elif word:
            words, word = [*words, word], ""
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))

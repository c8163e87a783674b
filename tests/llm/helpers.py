"""Brute-force versions and awkward rows shared by the tests of this folder."""

from __future__ import annotations

import random

DOCS = "id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubdfklmnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def awkward(first: int = 1000) -> list[tuple]:
    """Null and empty texts, null ids, white space, repeated rows, and one very long text."""
    long = prose(first, 30_000)
    return [
        (first, None, None, None, None), (first + 1, "", "en", "s", 0), (None, prose(1, 40), "en", None, 5), (None, None, None, "s", None),
        (first + 2, " \n\t ", "en", "s", 4), (first + 3, prose(2, 40), "en", "s", 9), (first + 3, prose(2, 40), "en", "s", 9), (first + 4, long, "en", None, len(long)),
        (first + 5, "?!", "en", "s", 2), (first + 6, "éßñ — ０", None, "s", 7),
    ]


def near_components(rows: list[tuple[int | None, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """id to (set size, smallest id reachable) by comparing all pairs; ids must have one text each."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        if i is not None:
            sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    words = text.split()
    for j in range(len(words)):
        if r.random() < share:
            words[j] = f"x{r.randint(0, 10**9)}"
    return " ".join(words)

"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, width: int = 5) -> set:
    words = re.findall(SPACE, lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def components(sets: list[set], num: int = 80, den: int = 100) -> list[int]:
    """Least index reachable by links, for every set."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    common = Counter((a, b) for at in index.values() for i, a in enumerate(at) for b in at[i + 1 :])
    for (a, b), c in common.items():
        if c * den >= (len(sets[a]) + len(sets[b]) - c) * num:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def removed_bytes(texts: list[bytes], length: int) -> list[bytearray]:
    """1 for every byte covered by a string of `length` bytes that also starts elsewhere."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        out.append(mask)
    return out


def line_keepers(docs: list[tuple[int, str | None]], width: int = 8) -> dict[int, set[int]]:
    """Line numbers to remove per document."""
    seen, places = {}, []
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" \t\n\r\x0b\f"):
                places.append((d, i, seen.setdefault(line, len(seen))))
    sets = [{x[i : i + width] for i in range(len(x) - width + 1)} or {x} for x in seen]
    root = components(sets)
    keep: dict[int, tuple[int, int]] = {}
    for d, i, k in places:
        keep[root[k]] = min(keep.get(root[k], (d, i)), (d, i))
    gone = defaultdict(set)
    for d, i, k in places:
        if keep[root[k]] != (d, i):
            gone[d].add(i)
    return gone


def repeat_words(words: list[str]) -> int:
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)})

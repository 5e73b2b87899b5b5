"""Suffix array of a block of texts by two-stage sorting, and the strings that repeat in it.

Stage one sorts only the suffixes that are smaller than their successors; stage two induces all
others by scanning the buckets of first characters in order: a suffix that is larger than its
successor takes its place in its bucket when the scan meets the successor. Order beyond `depth`
characters does not matter here and is left open. Common prefixes of neighbours come last.
"""

from __future__ import annotations

import numpy as np

from flowpanel.llm.rolling import Hashes

# Characters are bytes plus one, 0 separates texts; seven of them make one word.
BITS, PER_WORD = 9, 7


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, each followed by a separator; start of each text)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    raw[starts + lengths] = 0
    return raw, starts


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last one never is."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    up = np.zeros(n, dtype=bool)
    if len(change):
        rises = t[change] < t[change + 1]
        run = np.searchsorted(change, np.arange(n))  # the next change at or after a position decides
        inside = run < len(change)
        up[inside] = rises[run[inside]]
    return up


def _words(t: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Seven characters of each position as one number; what follows a separator counts as nothing."""
    padded = np.concatenate([t, np.zeros(PER_WORD, dtype=t.dtype)]).astype(np.uint64)
    out = np.zeros(len(t), dtype=np.uint64)
    for i in range(PER_WORD):
        out = (out << np.uint64(BITS)) | np.where(left > i, padded[i : i + len(t)], np.uint64(0))
    return out


def room(t: np.ndarray) -> np.ndarray:
    """Characters from each position to the next separator (or the end)."""
    ends = np.append(np.flatnonzero(t == 0), len(t))
    at = np.arange(len(t))
    return ends[np.searchsorted(ends, at)] - at


def _sort(places: np.ndarray, words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """`places` by the `depth` characters that follow, a word at a time among those still equal.

    Nothing is compared beyond a separator: texts that are equal up to it stay in any order.
    """
    order = places[np.argsort(words[places], kind="stable")]
    w = words[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = w[1:] != w[:-1]
    group = np.cumsum(new)
    active = np.arange(len(order))
    for off in range(PER_WORD, depth, PER_WORD):
        if not len(active):
            break
        g = group[active]
        active = active[(np.bincount(g)[g] > 1) & (left[order[active]] >= off)]
        if not len(active):
            break
        # A text that ends just here has a word of zero and comes first; those that ended before stand alone.
        key, g = words[order[active] + off], group[active]
        by = np.lexsort((key, g))
        order[active] = order[active][by]
        key, g = key[by], g[by]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[active] = np.cumsum(new)
    return order


def _sorted_small(small: np.ndarray, t: np.ndarray, words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The positions `small` in order; of those whose next `depth` characters are equal one is sorted."""
    whole = left[small] >= depth
    if not whole.any():
        return _sort(small, words, left, depth)
    full = small[whole]
    same = Hashes(t).windows(depth)[full]
    _, first, which, sizes = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    reps = full[first]
    order = _sort(np.concatenate([small[~whole], reps]), words, left, depth)
    # Every representative makes room for all it stands for.
    size_of = np.ones(len(t), dtype=np.int64)
    size_of[reps] = sizes
    slots = np.cumsum(size_of[order]) - size_of[order]
    out = np.empty(len(small), dtype=np.int64)
    out[slots] = order
    start_of = np.zeros(len(t), dtype=np.int64)
    start_of[order] = slots
    by = np.argsort(which, kind="stable")
    rank = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[start_of[reps[which[by]]] + rank] = full[by]
    return out


def suffix_array(t: np.ndarray, depth: int, words: np.ndarray | None = None, left: np.ndarray | None = None) -> np.ndarray:
    """All positions of `t` ordered by the suffixes' first `depth` characters, up to a separator."""
    n = len(t)
    if not n:
        return np.empty(0, dtype=np.int64)
    left = room(t) if left is None else left
    words = _words(t, left) if words is None else words
    up = smaller_than_next(t)
    small = _sorted_small(np.flatnonzero(up), t, words, left, depth)
    first = t[small]
    waiting: dict[int, list[np.ndarray]] = {int(t[-1]): [np.array([n - 1])]}  # the last suffix has no successor
    out = []
    chars = np.flatnonzero(np.bincount(t))

    def pass_on(region: np.ndarray) -> None:
        """Hand the predecessors that begin with a larger character to their buckets, in order."""
        before = region[region > 0] - 1
        before = before[t[before] > t[before + 1]]
        if len(before):
            c = t[before]
            by = np.argsort(c, kind="stable")
            before, c = before[by], c[by]
            cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
            for part in np.split(before, cuts):
                waiting.setdefault(int(t[part[0]]), []).append(part)

    for c in chars.tolist():
        level = np.concatenate(waiting.pop(c)) if c in waiting else np.empty(0, dtype=np.int64)
        large = []
        while len(level):
            large.append(level)
            level = level[level > 0] - 1
            level = level[t[level] == c]
        region = np.concatenate([*large, small[np.searchsorted(first, c) : np.searchsorted(first, c, "right")]])
        out.append(region)
        pass_on(region)
    return np.concatenate(out)


def equal_neighbours(t: np.ndarray, order: np.ndarray, depth: int, words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each neighbouring pair of `order`, whether the common prefix reaches `depth`.

    A pair whose next `depth` characters hold a separator does not count.
    """
    a, b = order[:-1], order[1:]
    equal = np.flatnonzero((left[a] >= depth) & (left[b] >= depth))
    whole, rest = divmod(depth, PER_WORD)
    for k in range(whole):
        equal = equal[words[a[equal] + k * PER_WORD] == words[b[equal] + k * PER_WORD]]
    for k in range(depth - rest, depth):
        equal = equal[t[a[equal] + k] == t[b[equal] + k]]
    out = np.zeros(max(len(order) - 1, 0), dtype=bool)
    out[equal] = True
    return out


def repeated(texts: list[bytes], owner: np.ndarray, offset: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, position) of every `depth`-byte string that also starts at another place.

    `owner` and `offset` say where a text comes from; the same place seen in two texts is one place.
    """
    t, starts = codes(texts)
    left = room(t)
    words = _words(t, left)
    order = suffix_array(t, depth, words, left)
    equal = equal_neighbours(t, order, depth, words, left)
    if not equal.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    run = np.zeros(len(order), dtype=np.int64)
    run[1:] = np.cumsum(~equal)
    in_run = np.zeros(len(order), dtype=bool)
    in_run[:-1] |= equal
    in_run[1:] |= equal
    at, run = order[in_run], run[in_run]
    text = np.searchsorted(starts, at, "right") - 1
    pos = at - starts[text]
    own, place = owner[text], offset[text] + pos
    cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    several = (np.minimum.reduceat(own, cuts) != np.maximum.reduceat(own, cuts)) | (
        np.minimum.reduceat(place, cuts) != np.maximum.reduceat(place, cuts))
    keep = np.repeat(several, np.diff(np.concatenate([cuts, [len(run)]])))
    return text[keep], pos[keep]

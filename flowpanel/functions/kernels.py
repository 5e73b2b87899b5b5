"""Numpy kernels that run inside Arrow tasks. They see one batch of rows at a time."""

import math

import numpy as np


# Pairs are warped in blocks whose diagonals stay in the processor cache.
BLOCK_CELLS = 32768
# Moves of all diagonals that a block may keep for its paths: one byte each.
BLOCK_MOVES = 1 << 26


# Cells of an anti-diagonal that are filled at once, so that its buffers stay in the second-level cache.
WARP_CELLS = 12288
# Steps of the sequences of a block of which only the distance is asked for.
PAIR_STEPS = 1 << 22


def _widest(n, m, band):
    """Cells of the longest anti-diagonal."""
    return min(n, m) if band is None else min(n, m, band + 1)


def block_size(n, m, band, keep_steps=False):
    """Pairs of sequences of n and m steps in a block."""
    widest = _widest(n, m, band)
    size = max(16, BLOCK_CELLS // widest)
    return max(1, min(size, BLOCK_MOVES // ((n + m) * widest))) if keep_steps else size


def pair_block(n, m, band):
    """Pairs in a block of which only the distance is asked for."""
    return max(1, min(max(16, WARP_CELLS // _widest(n, m, band)), PAIR_STEPS // (n + m)))


def _blocks(rows, n, m, band, keep_steps=False):
    size = block_size(n, m, band, keep_steps)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def _by_length(lefts, rights):
    """Row positions in groups of similar lengths, so that padding adds about an eighth; longer pairs first in a group."""
    groups = {}
    for pos, (a, b) in enumerate(zip(lefts, rights)):
        if a is not None and b is not None and len(a) and len(b):
            key = tuple(int(8 * math.log2(len(s))) for s in (a, b))
            groups.setdefault(key, []).append((-len(a) - len(b), pos))
    return [[pos for _, pos in sorted(group)] for group in groups.values()]


def _warp(x, y, band, moves=None, ends=None):
    """Cumulative warping cost of row-aligned sequences `x[B,n]` and `y[B,m]`.

    A diagonal move counts its local cost twice, the other two moves once. The table is filled
    one anti-diagonal at a time, for all pairs of the batch at once, and only inside the band
    |i - j| <= band. Steps lie in rows and pairs side by side, so every operation runs over memory
    in order, in buffers made once. Returns the costs and the first cell of each anti-diagonal; the
    chosen moves go to `moves[n+m-1, widest, B]` when it is given.

    Shorter sequences may be padded: `ends` has their lengths (n of x, m of y). A path to the last
    cell of a pair never leaves its own part of the table, so the padding does not count.
    """
    pairs, n = x.shape
    m = y.shape[1]
    width = max(n, m) if band is None else band
    x = x[:1].T if x.strides[0] == 0 else np.ascontiguousarray(x.T)
    y = np.ascontiguousarray(y.T[::-1])  # cells of one anti-diagonal read x forwards and y backwards
    # Row 0 is padding, so cell i of a diagonal sits at i + 1.
    older, old, new = (np.full((n + 2, pairs), np.inf) for _ in range(3))
    widest = _widest(n, m, band)
    costs, diagonals, lefts, ups = (np.empty((widest, pairs)) for _ in range(4))
    turns, again = (np.empty((widest, pairs), dtype=bool) for _ in range(2))
    firsts = []
    ended, out = {}, None
    if ends is not None:
        out = np.full(pairs, np.inf)
        last = ends[0] + ends[1] - 2
        for k in np.unique(last):
            ended[int(k)] = np.flatnonzero(last == k)
    for k in range(n + m - 1):
        lo = max(0, k - m + 1, -((width - k) // 2))
        hi = min(n - 1, k, (k + width) // 2)
        firsts.append(lo)
        if hi >= lo:
            size = hi - lo + 1
            cost, diagonal, left, best = costs[:size], diagonals[:size], lefts[:size], new[lo + 1 : hi + 2]
            new[lo], new[hi + 2] = np.inf, np.inf
            np.subtract(x[lo : hi + 1], y[m - 1 - k + lo : m - k + hi], out=cost)
            np.abs(cost, out=cost)
            if k == 0:
                best[:] = cost
                if moves is not None:
                    moves[0, :1] = 0
            else:
                np.add(cost, cost, out=diagonal)
                diagonal += older[lo : hi + 1]
                if moves is None:
                    np.minimum(old[lo + 1 : hi + 2], old[lo : hi + 1], out=left)
                    left += cost
                    np.minimum(diagonal, left, out=best)
                else:
                    up, off, next_off = ups[:size], turns[:size], again[:size]
                    np.add(old[lo + 1 : hi + 2], cost, out=left)
                    np.add(old[lo : hi + 1], cost, out=up)
                    np.minimum(diagonal, left, out=best)
                    np.minimum(best, up, out=best)
                    # 0 for a diagonal move, else 1 for one from the left, else 2.
                    np.not_equal(diagonal, best, out=off)
                    np.not_equal(left, best, out=next_off)
                    next_off &= off
                    np.add(off.view(np.int8), next_off.view(np.int8), out=moves[k, :size])
        else:
            new[:] = np.inf
        rows = ended.get(k)
        if rows is not None:
            cell = ends[0][rows] - 1
            out[rows] = np.where((cell >= lo) & (cell <= hi), new[cell + 1, rows], np.inf)
        older, old, new = old, new, older
    return (old[n].copy() if out is None else out), np.asarray(firsts)


def dtw_distances(lefts, rights, band):
    """Warping distance per pair; NaN where no path stays inside the band.

    Pairs of similar lengths share a block, padded to its longest sequences.
    """
    out = np.full(len(lefts), np.nan)
    for positions in _by_length(lefts, rights):
        sizes = np.array([[len(lefts[r]), len(rights[r])] for r in positions])
        n, m = (int(v) for v in sizes.max(axis=0))
        size = pair_block(n, m, band)
        for at in range(0, len(positions), size):
            rows, ends = positions[at : at + size], sizes[at : at + size].T
            x, y = (np.zeros((len(rows), int(lengths.max()))) for lengths in ends)
            for k, r in enumerate(rows):
                x[k, : ends[0, k]] = np.asarray(lefts[r], dtype=float)
                y[k, : ends[1, k]] = np.asarray(rights[r], dtype=float)
            cost, _ = _warp(x, y, band, ends=ends)
            out[rows] = np.where(np.isfinite(cost), cost, np.nan)
    return out


def dtw_paths(x, y, band):
    """Costs of a batch and, per pair, the cells (i, j) of the path from last to first."""
    pairs, n = x.shape
    m = y.shape[1]
    widest = _widest(n, m, band)
    moves = np.zeros((n + m - 1, widest, pairs), dtype=np.int8)
    cost = np.empty(pairs)
    step = max(1, WARP_CELLS // widest)
    for k in range(0, pairs, step):
        own = slice(k, k + step)
        cost[own], firsts = _warp(x[own], y[own], band, moves[:, :, own])
    # The move of cell (i, j) of pair p lies at start[i + j] + i * pairs + p.
    start = (np.arange(n + m - 1) * widest - firsts) * pairs
    moves, rows = moves.reshape(-1), np.arange(pairs)
    i, k = np.full(pairs, n - 1), np.full(pairs, n + m - 2)
    live = np.isfinite(cost)
    cells = []
    while live.any():
        cells.append((i, k - i, live))
        live = live & (k > 0)
        move = moves.take(start[k] + i * pairs + rows, mode="clip")
        i = i - (live & (move != 1))
        k = k - live - (live & (move == 0))
    return cost, cells


def barycenter_sums(sequences, centroid, band, weights=None):
    """Sum and count of the sequence values aligned to each step of the centroid.

    A sequence with a weight counts as so many equal ones.
    """
    total = np.zeros(len(centroid))
    count = np.zeros(len(centroid), dtype=np.int64)
    weights = np.ones(len(sequences), dtype=np.int64) if weights is None else np.asarray(weights, dtype=np.int64)
    lengths = {}
    for s, w in zip(sequences, weights):
        if s is not None and len(s):
            lengths.setdefault(len(s), []).append((np.asarray(s, dtype=float), w))
    for length, group in lengths.items():
        for block in _blocks(group, len(centroid), length, band, keep_steps=True):
            y = np.stack([s for s, _ in block])
            w = np.array([w for _, w in block], dtype=np.int64)
            x = np.broadcast_to(np.asarray(centroid, dtype=float), (len(block), len(centroid)))
            _, cells = dtw_paths(x, y, band)
            if not cells:
                continue
            live = np.stack([c[2] for c in cells])
            i = np.stack([c[0] for c in cells])[live]
            values = np.stack([y[np.arange(len(block)), c[1]] for c in cells])[live]
            times = np.broadcast_to(w, live.shape)[live]
            total += np.bincount(i, weights=values * times, minlength=len(centroid))
            count += np.bincount(i, weights=times, minlength=len(centroid)).astype(np.int64)
    return total, count


def gaussian_noise_estimate(x, t, alpha_hat, batch):
    """The noise a diagonal Gaussian prior expects at `x`, in closed form.

    `batch["mu"]` and `batch["var"]` have the shape of `x`. Any function with this signature can
    take its place; `batch` carries the conditions of each row.
    """
    mu, var = batch["mu"], batch["var"]
    return np.sqrt(1 - alpha_hat) * (x - np.sqrt(alpha_hat) * mu) / (alpha_hat * var + 1 - alpha_hat)


# Noise is drawn for this many steps at a time, and rows are denoised in blocks of this size.
NOISE_STEPS = 50
BLOCK_ROWS = 128


def _denoise_block(batch, keys, betas, seed, temperature, predictor):
    alphas = 1 - betas
    alphas_hat = np.cumprod(alphas)
    shape = batch["mu"].shape[1:]
    streams = [
        np.random.Generator(np.random.Philox(key=[np.uint64(seed), np.uint64(key & 0xFFFFFFFFFFFFFFFF)]))
        for key in keys
    ]
    noise = np.empty((len(keys), NOISE_STEPS, *shape))
    left = 0

    def draw():
        nonlocal left
        if left == 0:
            for stream, rows in zip(streams, noise):
                stream.standard_normal(out=rows)
            left = NOISE_STEPS
        left -= 1
        return noise[:, NOISE_STEPS - 1 - left]

    x = draw().copy()
    for t in range(len(betas) - 1, -1, -1):
        estimate = predictor(x, t, alphas_hat[t], batch)
        x = (x - (1 - alphas[t]) / np.sqrt(1 - alphas_hat[t]) * estimate) / np.sqrt(alphas[t])
        if t > 0:
            x += np.sqrt(betas[t]) * temperature * draw()
    return x


def reverse_diffusion(batch, keys, betas, seed, temperature, predictor):
    """Denoise one sample per key from step T-1 to 0; noise is off in the last step.

    Each row owns a counter-based generator keyed by (seed, key), so its trace does not depend
    on the batch it lands in.
    """
    done = []
    for k in range(0, len(keys), BLOCK_ROWS):
        rows = slice(k, k + BLOCK_ROWS)
        block = {name: values[rows] for name, values in batch.items()}
        done.append(_denoise_block(block, keys[rows], betas, seed, temperature, predictor))
    return np.concatenate(done)

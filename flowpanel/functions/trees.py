"""Numpy kernels that grow decision trees level by level on counted cells of binned predictors."""

import numpy as np

LEAF = -1


def _children(feature, cut, split_nodes, left):
    """Give the split nodes two children each, numbered behind all nodes so far."""
    start = len(feature)
    left[split_nodes] = start + 2 * np.arange(len(split_nodes))
    more = 2 * len(split_nodes)
    grow = lambda a, v: np.concatenate([a, np.full(more, v, dtype=a.dtype)])
    return grow(feature, LEAF), grow(cut, 0), grow(left, 0)


def _best_split(x, at, nodes, width, a, b, score, allowed):
    """Per open node the best (gain, feature, cut) of sums `a` and `b` of its cells.

    `score(a, b)` is what a node is worth; a split gains what its sides are worth above the node.
    Equal gains go to the first feature and the lowest cut. `allowed[node, feature]` says what may
    be tried.
    """
    total_a, total_b = np.bincount(at, a, nodes), np.bincount(at, b, nodes)
    whole = score(total_a, total_b)
    best = np.full(nodes, -np.inf)
    feature, cut = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    for f in range(x.shape[1]):
        place = at * width + x[:, f]
        left_a = np.bincount(place, a, nodes * width).reshape(nodes, width).cumsum(1)[:, :-1]
        left_b = np.bincount(place, b, nodes * width).reshape(nodes, width).cumsum(1)[:, :-1]
        gain = score(left_a, left_b) + score(total_a[:, None] - left_a, total_b[:, None] - left_b) - whole[:, None]
        gain[~allowed[:, f]] = -np.inf
        j = gain.argmax(1)
        g = gain[np.arange(nodes), j]
        better = g > best + 1e-12
        best[better], feature[better], cut[better] = g[better], f, j[better]
    return best, feature, cut, total_a, total_b


def _grow(x, a, b, width, score, can_split, choose, depth, least_gain):
    """(feature, cut, left child) per node, the node of every cell, the gain per feature.

    Cells with neither `a` nor `b` walk along and decide nothing.
    """
    feature, cut, left = np.array([LEAF]), np.array([0]), np.array([0])
    node = np.zeros(len(x), dtype=np.int64)
    gains = np.zeros(x.shape[1])
    frontier, level = np.array([0]), 0
    while len(frontier) and (depth is None or level < depth):
        number = np.full(len(feature), -1)
        number[frontier] = np.arange(len(frontier))
        here = np.flatnonzero(number[node] >= 0)
        at = number[node[here]]
        best, f, c, total_a, total_b = _best_split(x[here], at, len(frontier), width, a[here], b[here], score, choose(len(frontier)))
        ok = can_split(total_a, total_b) & (best > least_gain)
        split_nodes = frontier[ok]
        feature[split_nodes], cut[split_nodes] = f[ok], c[ok]
        np.add.at(gains, f[ok], best[ok])
        feature, cut, left = _children(feature, cut, split_nodes, left)
        moving = here[ok[at]]
        own = node[moving]
        node[moving] = left[own] + (x[moving, feature[own]] > cut[own])
        frontier, level = np.concatenate([left[split_nodes], left[split_nodes] + 1]), level + 1
    return feature, cut, left, node, gains


def forest_tree(x, n0, n1, width, mtry, min_rows, rng):
    """One tree of a probability forest on a bootstrap of the counted cells, grown without a depth limit.

    A cell of n rows is drawn a Poisson(n) number of times, as n rows drawn once each on average.
    Returns the tree (feature, cut, left, value), the value of every cell and the impurity gains.
    """
    w0, w1 = rng.poisson(n0).astype(float), rng.poisson(n1).astype(float)

    def score(a, b):  # minus rows times the Gini impurity
        n = a + b
        return -2 * a * b / np.where(n > 0, n, 1)

    def choose(nodes):
        order = rng.random((nodes, x.shape[1])).argsort(1)
        return order < mtry

    def can_split(a, b):
        return (a > 0) & (b > 0) & (a + b >= max(min_rows, 2))

    feature, cut, left, node, gains = _grow(x, w0, w1, width, score, can_split, choose, None, 1e-9)
    value = _node_shares(feature, cut, left, x, w0, w1)
    return (feature, cut, left, value), value[node], gains


def _node_shares(feature, cut, left, x, w0, w1):
    """Share of label 1 in every node; without rows that of its parent."""
    a, b = np.zeros(len(feature)), np.zeros(len(feature))
    node = np.zeros(len(x), dtype=np.int64)
    value = np.full(len(feature), 0.5)
    parent = np.full(len(feature), -1)
    inner = np.flatnonzero(feature != LEAF)
    parent[left[inner]], parent[left[inner] + 1] = inner, inner
    live = np.arange(len(x))
    while len(live):
        np.add.at(a, node[live], w0[live])
        np.add.at(b, node[live], w1[live])
        live = live[feature[node[live]] != LEAF]
        own = node[live]
        node[live] = left[own] + (x[live, feature[own]] > cut[own])
    for k in range(len(feature)):  # parents come before their children
        if a[k] + b[k] > 0:
            value[k] = b[k] / (a[k] + b[k])
        elif parent[k] >= 0:
            value[k] = value[parent[k]]
    return value


def boosted_trees(x, n0, n1, width, rounds, depth, rate, ridge=1.0, least_weight=1.0):
    """Boosting of the logistic loss with first and second derivatives, on counted cells.

    Returns the trees (feature, cut, left, value), the margin of every cell and the gains.
    """
    margin, n = np.zeros(len(x)), (n0 + n1).astype(float)
    gains, trees = np.zeros(x.shape[1]), []

    def score(g, h):
        return np.where(h >= least_weight, g * g / (h + ridge), -np.inf) / 2

    def choose(nodes):
        return np.ones((nodes, x.shape[1]), dtype=bool)

    def can_split(g, h):
        return h >= 2 * least_weight

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = n * p - n1, n * p * (1 - p)
        with np.errstate(invalid="ignore"):
            feature, cut, left, node, gained = _grow(x, g, h, width, score, can_split, choose, depth, 1e-9)
        nodes = len(feature)
        value = -rate * np.bincount(node, g, nodes) / (np.bincount(node, h, nodes) + ridge)
        margin += value[node]
        gains += gained
        trees.append((feature, cut, left, value))
    return trees, margin, gains


def walk(tree, x):
    """The value of the leaf that each row of bins reaches."""
    feature, cut, left, value = tree
    node = np.zeros(len(x), dtype=np.int64)
    live = np.flatnonzero(feature[node] != LEAF)
    while len(live):
        own = node[live]
        node[live] = left[own] + (x[live, feature[own]] > cut[own])
        live = live[feature[node[live]] != LEAF]
    return value[node]

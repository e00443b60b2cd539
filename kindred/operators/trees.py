"""Cluster trees on numpy: single linkage of mutual reachability distances, condensed; and average linkage."""

from __future__ import annotations

import numpy as np


def spanning_tree(x: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """Edges (length, a, b), ascending, of the minimum spanning tree under mutual reachability; rows are unit vectors.

    A row of distances is made when a point joins, so memory grows with the points and not with their pairs."""
    n, q = len(x), (x * x).sum(axis=1)

    def to(i: int) -> np.ndarray:
        d = q + q[i] - 2 * (x @ x[i])
        d[d < 1e-14] = 0.0  # what rounding leaves between copies
        d[i] = 0.0
        return np.sqrt(d)

    core = np.array([np.partition(to(i), min(k, n) - 1)[min(k, n) - 1] for i in range(n)])
    joined, best, parent = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, np.int64)
    now, out = 0, []
    for _ in range(n - 1):
        joined[now] = True
        m = np.maximum(np.maximum(to(now), core), core[now])
        closer = (m < best) & ~joined
        best[closer], parent[closer] = m[closer], now
        now = int(np.where(joined, np.inf, best).argmin())
        out.append((float(best[now]), int(parent[now]), now))
    return sorted(out)


def density_labels(x: np.ndarray, min_cluster_size: int, min_samples: int) -> np.ndarray:
    """Labels from 0 and -1 for noise of unit vectors."""
    return condensed_labels(len(x), spanning_tree(x, max(1, min_samples)) if len(x) >= max(2, min_cluster_size) else [], min_cluster_size)


def condensed_labels(n: int, tree: list[tuple[float, int, int]], min_cluster_size: int) -> np.ndarray:
    """Labels from the ascending edges of a spanning tree, by excess of mass over the condensed tree; the root is never a cluster."""
    labels = np.full(n, -1)
    size = max(2, min_cluster_size)
    if n < size:
        return labels
    # Single linkage: node n + k joins two nodes at a length.
    parent = list(range(2 * n - 1))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    kids, weight, height = {}, [1] * n, {}
    for k, (d, a, b) in enumerate(tree):
        a, b, node = root(a), root(b), n + k
        parent[a] = parent[b] = node
        kids[node], height[node] = (a, b), d
        weight.append(weight[a] + weight[b])

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            a = stack.pop()
            if a < n:
                out.append(a)
            else:
                stack += kids[a]
        return out

    # Condensed: clusters with their birth, the points that leave them and when, and the clusters they split into.
    births, left, splits = [0.0], [[]], [[]]
    stack = [(2 * n - 2, 0)] if n > 1 else []
    while stack:
        node, own = stack.pop()
        if node < n:
            left[own].append((node, np.inf))
            continue
        rate = 1 / height[node] if height[node] > 0 else np.inf
        a, b = kids[node]
        large = [c for c in (a, b) if weight[c] >= size]
        if len(large) == 2:
            for c in (a, b):
                births.append(rate)
                left.append([])
                splits.append([])
                splits[own].append((len(births) - 1, weight[c]))
                stack.append((c, len(births) - 1))
        else:
            for c in (a, b):
                if c in large:
                    stack.append((c, own))
                else:
                    left[own] += [(p, rate) for p in points(c)]
    cap = max((r for g in left for _, r in g if np.isfinite(r)), default=1.0) * 10

    def mass(c: int) -> float:
        end = [(min(r, cap), 1) for _, r in left[c]] + [(min(births[k], cap), w) for k, w in splits[c]]
        return sum((r - min(births[c], cap)) * w for r, w in end)

    stable = [mass(c) for c in range(len(births))]
    chosen = [True] * len(births)
    for c in reversed(range(len(births))):  # children come after their parents
        below = sum(stable[k] for k, _ in splits[c])
        if c == 0 or (splits[c] and stable[c] < below):
            chosen[c], stable[c] = False, below
    label = 0
    stack = [(0, -1)]
    while stack:
        c, under = stack.pop()
        if under < 0 and chosen[c]:
            under, label = label, label + 1
        for p, _ in left[c]:
            labels[p] = under
        stack += [(k, under) for k, _ in reversed(splits[c])]
    return labels


def average_labels(x: np.ndarray, threshold: float) -> np.ndarray:
    """Labels by average linkage of cosine distances: the nearest two clusters join while they are nearer than ``threshold``."""
    found = [np.nonzero(1 - x[s : s + 256] @ x.T < threshold) for s in range(0, len(x), 256)]
    a, b = (np.concatenate([f[k] + 256 * t * (k == 0) for t, f in enumerate(found)]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return linked_labels(x, np.ones(len(x)), a[a < b], b[a < b], threshold)


def linked_labels(total: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Labels by average linkage of clusters, each the sum of its unit vectors and their number. ``a`` and ``b`` link the
    clusters nearer than ``threshold``, each two once.

    The average over pairs needs only sums and sizes, so no distances are kept. Joining two clusters brings neither nearer
    to a third than the nearer one was. So clusters that are each other's nearest may join in any order: a chain of nearest
    clusters is followed until it turns back. And what is near a joined cluster was near one of the two, so only links are
    looked at, and those that have become too long are dropped."""
    n = len(total)
    total, size, owner = total.astype(np.float64), size.astype(np.float64), np.arange(n)
    ends, others = np.concatenate([a, b]).astype(np.int32), np.concatenate([b, a]).astype(np.int32)
    at = np.argsort(ends, kind="stable")
    first, others = np.searchsorted(ends[at], np.arange(n + 1)).tolist(), others[at]
    del ends, at
    links = [others[first[k] : first[k + 1]] for k in range(n)]

    def near(k: int) -> tuple[np.ndarray, np.ndarray]:
        r = owner[links[k]]
        while not np.array_equal(up := owner[r], r):
            r = up
        owner[links[k]] = r
        r = np.unique(r)
        r = r[r != k]
        d = 1 - (total[r] @ total[k]) / (size[r] * size[k])
        keep = d < threshold
        links[k] = r[keep]
        return r[keep], d[keep]

    todo, chain = list(range(n - 1, -1, -1)), []
    while todo or chain:
        if not chain:
            if owner[k := todo.pop()] != k:
                continue
            chain.append(k)
        k = chain[-1]
        r, d = near(k)
        if not len(r):
            chain.pop()
            continue
        at = int(d.argmin())
        other, before = int(r[at]), chain[-2] if len(chain) > 1 else -1
        if before >= 0 and other != before and (same := np.flatnonzero(r == before)).size and d[same[0]] <= d[at]:
            other = before  # of equal ones that which led here
        if other == before:
            del chain[-2:]
            total[other] += total[k]
            size[other] += size[k]
            owner[k] = other
            links[other] = np.concatenate([links[other], links[k]])
            links[k] = links[k][:0]
            todo.append(other)
        else:
            chain.append(other)
    while not np.array_equal(up := owner[owner], owner):
        owner = up
    names, where = np.unique(owner, return_index=True)
    place = np.empty(n, np.int64)
    place[names[np.argsort(where)]] = np.arange(len(names))
    return place[owner]


def joined_edges(a: np.ndarray, b: np.ndarray, w: np.ndarray, comp: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boruvka's rounds over the edges that are known: positions of those taken, each point's component after them, and a
    mark on the points whose unknown edges must be found to go on.

    No unknown edge of a point is shorter than its ``bound``. So a component's shortest known edge is its shortest of all
    if it is no longer than the bounds of its points; edges of one length are ordered by their ends, so no circle arises."""
    n, taken = len(comp), []
    at = np.lexsort((b, a, w))
    while True:
        at = at[comp[a[at]] != comp[b[at]]]
        ca, cb, none = comp[a[at]], comp[b[at]], len(at)
        best = np.full(n, none)
        for c in (ca, cb):
            own = np.full(n, none)
            own[c[::-1]] = np.arange(none)[::-1]  # the last one written stays: the shortest
            best = np.minimum(best, own)
        length = np.append(w[at], np.inf)[best]
        least = np.full(n, np.inf)
        np.minimum.at(least, comp, bound)
        sure = np.flatnonzero((best < none) & (length <= least))
        if not len(sure):
            break
        taken.append(at[np.unique(best[sure])])
        up = np.arange(n)
        up[sure] = ca[best[sure]] + cb[best[sure]] - sure
        mutual = sure[(up[up[sure]] == sure) & (sure < up[sure])]
        up[mutual] = mutual
        while not np.array_equal(over := up[up], up):
            up = over
        comp = up[comp]
    lacks = bound < length[comp]
    if (comp != comp[:1]).any():
        lacks &= comp != np.bincount(comp[lacks], minlength=n).argmax()  # the others join the one that would take longest
    else:
        lacks[:] = False
    return np.concatenate(taken) if taken else np.zeros(0, np.int64), comp, lacks

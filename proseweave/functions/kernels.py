"""Dense arithmetic on one tile of sentences (two bounded blocks), used inside Arrow batches.

A tile is two matrices of at most ``block`` rows, so nothing here ever sees a whole story of
unbounded length. Spark builds, shuffles and aggregates the tiles.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def cosine_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of all rows of ``a`` against all rows of ``b``; NaN for zero vectors."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ua = a / np.linalg.norm(a, axis=1, keepdims=True)
        ub = b / np.linalg.norm(b, axis=1, keepdims=True)
    return 1.0 - ua @ ub.T


def multiset_jaccard(a, b) -> float:
    """Shared over total tokens, counting repeats. Equal lists give 1, one empty list gives 0."""
    ca, cb = Counter(a), Counter(b)
    if ca == cb:
        return 1.0
    shared = sum((ca & cb).values())
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def jaccard_tile(a: list, b: list) -> np.ndarray:
    """``multiset_jaccard`` of all rows of ``a`` against all rows of ``b``, from one count matrix for each block."""
    ids: dict = {}
    coded = [[ids.setdefault(t, len(ids)) for t in x] for x in (*a, *b)]
    counts = np.zeros((len(coded), len(ids)), np.int32)
    for row, x in zip(counts, coded):
        np.add.at(row, x, 1)
    left, right = counts[: len(a)], counts[len(a) :]
    shared = np.array([np.minimum(row, right).sum(axis=1) for row in left], dtype=float).reshape(len(a), len(b))
    total = left.sum(axis=1)[:, None] + right.sum(axis=1)[None, :] - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)


def word_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit word vectors."""
    ua = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    ub = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    return np.sqrt(np.maximum(2.0 - 2.0 * ua @ ub.T, 0.0))


def relaxed_transport(costs: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> float:
    """Larger of the two one-sided lower bounds of the transport cost."""
    return float(max(costs.min(axis=1) @ wa, costs.min(axis=0) @ wb))


def exact_transport(costs: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> float:
    """Optimal transport cost by the transportation simplex.

    Counts are scaled to equal integer totals and shifted by the usual tiny perturbation, which
    rules out degenerate pivots and therefore cycling. The optimum is read off the dual prices.
    """
    m, n = costs.shape
    a, b = np.round(wa).astype(np.int64), np.round(wb).astype(np.int64)
    ta, tb = int(a.sum()), int(b.sum())
    supply = [int(x) * tb * (m + 1) + 1 for x in a]
    demand = [int(x) * ta * (m + 1) for x in b]
    demand[-1] += m
    flow: dict[tuple[int, int], int] = {}
    left_s, left_d = supply[:], demand[:]
    # start: cells first that are cheap for their row and column
    for cell in np.argsort(costs - costs.mean(axis=1)[:, None] - costs.mean(axis=0), axis=None, kind="stable"):
        i, j = divmod(int(cell), n)
        x = min(left_s[i], left_d[j])
        if x:
            flow[i, j] = x
            left_s[i] -= x
            left_d[j] -= x
    near: list[set[int]] = [set() for _ in range(m + n)]
    for i, j in flow:
        near[i].add(m + j)
        near[m + j].add(i)
    for first in range(1, m + n):  # cells emptied together would leave the tree in parts
        if len(flow) == m + n - 1:
            break
        _bridge(flow, near, m, n)
    cost = costs.tolist()
    price, up, depth = [0.0] * (m + n), [-1] * (m + n), [0] * (m + n)

    def hang(root: int) -> None:
        """Parents, depths and prices of all that hangs on ``root``, which has its own."""
        order = [root]
        for v in order:
            for w in near[v]:
                if w != up[v]:
                    up[w], depth[w] = v, depth[v] + 1
                    price[w] = (cost[v][w - m] if v < m else cost[w][v - m]) - price[v]
                    order.append(w)

    hang(0)
    while True:
        prices = np.array(price)
        reduced = costs - prices[:m, None] - prices[None, m:]
        i, j = divmod(int(reduced.argmin()), n)
        if reduced[i, j] >= -1e-12:
            return float((a * tb) @ prices[:m] + (b * ta) @ prices[m:]) / (ta * tb)
        from_j, from_i, x, y = [], [], m + j, i
        while x != y:
            if depth[x] >= depth[y]:
                from_j.append((x, up[x]))
                x = up[x]
            else:
                from_i.append((up[y], y))
                y = up[y]
        loop = [(min(p), max(p) - m) for p in from_j + from_i[::-1]]
        out = min(loop[::2], key=lambda e: flow[e])
        amount = flow[out]
        for k, e in enumerate(loop):
            flow[e] += amount if k % 2 else -amount
        del flow[out]
        flow[i, j] = amount
        near[out[0]].discard(m + out[1])
        near[m + out[1]].discard(out[0])
        near[i].add(m + j)
        near[m + j].add(i)
        # what hung on the edge that left hangs on the new one: on j's end if it left on j's side of the loop
        low, high = (m + j, i) if loop.index(out) < len(from_j) else (i, m + j)
        up[low], depth[low], price[low] = high, depth[high] + 1, cost[i][j] - price[high]
        hang(low)


def _bridge(flow: dict, near: list[set[int]], m: int, n: int) -> None:
    """Connect two parts of the basis with an empty cell."""
    seen, order = {0}, [0]
    for v in order:
        for w in near[v]:
            if w not in seen:
                seen.add(w)
                order.append(w)
    rest = [v for v in range(m + n) if v not in seen]
    v = rest[0]
    u = next(x for x in order if (x < m) != (v < m))
    flow[min(u, v), max(u, v) - m] = 0
    near[u].add(v)
    near[v].add(u)

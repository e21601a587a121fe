"""Small dense solvers for one story of at most a few dozen sentences.

Each takes the n x d sentence matrix (or its Gram matrix) that Spark gathered under a size bound.
"""

from __future__ import annotations

import numpy as np


def component_shares(e: np.ndarray) -> np.ndarray:
    """Variance shares of the principal components with sentences as variables and vector entries
    as samples; n - 1 of them are kept, as shares of the total variance."""
    x = e - e.mean(axis=1, keepdims=True)
    values = np.sort(np.maximum(np.linalg.eigvalsh(x @ x.T), 0.0))[::-1]
    total = values.sum()
    return values[: max(len(e) - 1, 0)] / total if total > 0 else np.full(max(len(e) - 1, 0), np.nan)


def pca_scores(e: np.ndarray, threshold: float = 0.5) -> tuple[float, float]:
    """(1 - share of the first two components, share of components needed to reach ``threshold``)."""
    shares = component_shares(e)
    if len(shares) == 0:
        return 1.0, float("nan")
    reached = np.flatnonzero(np.cumsum(shares) >= threshold)
    needed = reached[0] + 1 if len(reached) else 1
    return 1.0 - float(shares[:2].sum()), needed / len(shares)


def shrunk_regression(gram: np.ndarray, xy: np.ndarray, yy: float, samples: int, alpha: float, l1: float = 1.0,
                      tol: float = 1e-4, sweeps: int = 1000) -> np.ndarray:
    """Coordinate descent for 1/(2N)|y - Xw|^2 + a*l1*|w|_1 + a*(1-l1)/2*|w|^2 on centred moments.

    Stops when the weights settle and the duality gap is below ``tol * y'y``.
    """
    n = len(xy)
    lasso, ridge = alpha * l1 * samples, alpha * (1 - l1) * samples
    w = np.zeros(n)
    fitted = np.zeros(n)  # gram @ w
    for sweep in range(sweeps):
        largest = change = 0.0
        for j in range(n):
            if gram[j, j] == 0.0:
                continue
            old = w[j]
            rho = xy[j] - fitted[j] + gram[j, j] * old
            w[j] = np.sign(rho) * max(abs(rho) - lasso, 0.0) / (gram[j, j] + ridge)
            if w[j] != old:
                fitted += (w[j] - old) * gram[:, j]
            change, largest = max(change, abs(w[j] - old)), max(largest, abs(w[j]))
        if largest == 0.0 or change / largest < tol or sweep == sweeps - 1:
            grad = xy - fitted - ridge * w
            residual = yy - 2 * w @ xy + w @ fitted
            bound, w2 = np.abs(grad).max(initial=0.0), w @ w
            scale = lasso / bound if bound > lasso else 1.0
            gap = 0.5 * residual * (1 + scale**2) if scale < 1 else residual
            gap += lasso * np.abs(w).sum() - scale * (yy - w @ xy) + 0.5 * ridge * (1 + scale**2) * w2
            if gap < tol * yy:
                break
    return w


def _fit(x: np.ndarray, y: np.ndarray, method: str, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of y on the columns of x."""
    mx, my = x.mean(axis=0), y.mean()
    xc, yc = x - mx, y - my
    gram, xy = xc.T @ xc, xc.T @ yc
    if method == "Ridge":
        w = np.linalg.solve(gram + alpha * np.eye(len(gram)), xy)
    elif method in ("Lasso", "ElasticNet"):
        w = shrunk_regression(gram, xy, float(yc @ yc), len(y), alpha, 1.0 if method == "Lasso" else 0.5)
    else:
        raise ValueError(f"unknown regression {method!r}; choose Lasso, Ridge or ElasticNet")
    return w, my - mx @ w


def regression_scores(e: np.ndarray, target: np.ndarray, method: str = "Lasso", alpha: float = 0.01) -> tuple[float, float]:
    """(share of non-zero weights, 1 - R^2) of the paragraph vector on the sentence vectors."""
    x = e.T
    w, b = _fit(x, target, method, alpha)
    spread = ((target - target.mean()) ** 2).sum()
    missed = ((target - x @ w - b) ** 2).sum()
    return np.count_nonzero(w) / len(w), float(missed / spread) if spread > 0 else float("nan")


def elimination_share(e: np.ndarray, target: np.ndarray, alpha: float = 0.01, folds: int = 5) -> float:
    """Best number of sentences / n, when the weakest sentence is dropped one at a time and each
    size from 1 to n - 2 is scored by unshuffled cross-validated squared error."""
    n, x = len(e), e.T
    if n <= 2 or len(target) < folds:
        return 0.0
    cuts = np.array_split(np.arange(len(target)), folds)
    kept, score = list(range(n)), {}
    while True:
        if len(kept) <= n - 2:
            errors = []
            for test in cuts:
                train = np.setdiff1d(np.arange(len(target)), test)
                w, b = _fit(x[np.ix_(train, kept)], target[train], "Lasso", alpha)
                errors.append(((target[test] - x[np.ix_(test, kept)] @ w - b) ** 2).mean())
            score[len(kept)] = float(np.mean(errors))
        if len(kept) == 1:
            break
        w, _ = _fit(x[:, kept], target, "Lasso", alpha)
        kept.pop(int(np.argmin(w**2)))
    return min(sorted(score), key=lambda k: score[k]) / n


def distances(e: np.ndarray) -> np.ndarray:
    diff = e[:, None, :] - e[None, :, :]
    return np.sqrt((diff * diff).sum(axis=2))


def mean_shift(e: np.ndarray, quantile: float = 0.3, max_steps: int = 300) -> np.ndarray:
    """Flat-kernel mean shift from every point; bandwidth = mean distance to the
    max(1, floor(quantile * n))-th neighbour, the point itself included."""
    n = len(e)
    k = max(1, int(n * quantile))
    band = float(np.sort(distances(e), axis=1)[:, k - 1].mean())
    band += 1e-9 * float(np.abs(e).max())  # a mean of identical vectors is only equal up to rounding
    ends: dict[tuple, int] = {}
    for seed in e:
        here = seed
        for _ in range(max_steps):
            near = np.sqrt(((e - here) ** 2).sum(axis=1)) <= band
            if not near.any():
                break
            step = e[near].mean(axis=0)
            moved = np.sqrt(((step - here) ** 2).sum())
            here = step
            if moved <= 1e-3 * band:
                break
        if near.any():
            ends[tuple(here)] = int(near.sum())
    order = sorted(ends.items(), key=lambda kv: (kv[1], kv[0]), reverse=True)
    centres: list[np.ndarray] = []
    for point, _ in order:
        p = np.array(point)
        if all(np.sqrt(((p - c) ** 2).sum()) > band for c in centres):
            centres.append(p)
    gaps = np.stack([np.sqrt(((e - c) ** 2).sum(axis=1)) for c in centres])
    return gaps.argmin(axis=0)


def _merge_order(reach: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a minimum spanning tree (grown from point 0), lightest first."""
    n = len(reach)
    best, origin = np.full(n, np.inf), np.zeros(n, int)
    outside = np.ones(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        outside[at] = False
        closer = outside & (reach[at] < best)
        best[closer], origin[closer] = reach[at][closer], at
        nxt = int(np.where(outside, best, np.inf).argmin())
        edges.append((int(origin[nxt]), nxt, float(best[nxt])))
        at = nxt
    return sorted(edges, key=lambda t: t[2])


def density_clusters(e: np.ndarray, smallest: int = 2) -> np.ndarray:
    """Hierarchical density clustering: mutual-reachability tree, condensed at ``smallest``,
    clusters chosen by excess of mass; -1 is noise."""
    n = len(e)
    d = distances(e)
    core = np.sort(d, axis=1)[:, min(smallest, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # merge tree: nodes 0..n-1 are points, node n + k is the k-th merge
    top, node = list(range(n)), {}
    members = {i: [i] for i in range(n)}
    for k, (a, b, w) in enumerate(_merge_order(reach)):
        ra, rb = top[a], top[b]
        node[n + k] = (ra, rb, w)
        members[n + k] = members[ra] + members[rb]
        for p in members[n + k]:
            top[p] = n + k
    if n < 2:
        return np.full(n, -1)
    # condense from the root: (points that leave, lambda) per cluster, and its child clusters
    root = n + n - 2
    birth, leaves, kids, parent = {0: 0.0}, {0: []}, {0: []}, {}
    stack = [(root, 0)]
    while stack:
        at, cl = stack.pop()
        a, b, w = node[at]
        lam = 1.0 / w if w > 0 else np.inf
        big = [c for c in (a, b) if len(members[c]) >= smallest]
        if len(big) == 2:
            for c in (a, b):
                new = len(birth)
                birth[new], leaves[new], kids[new], parent[new] = lam, [], [], cl
                kids[cl].append((new, lam, len(members[c])))
                stack.append((c, new))
        else:
            for c in (a, b):
                if c in big:
                    stack.append((c, cl))
                else:
                    leaves[cl] += [(p, lam) for p in members[c]]
    with np.errstate(invalid="ignore"):
        mass = {
            c: sum(l - birth[c] for _, l in leaves[c]) + sum((l - birth[c]) * s for _, l, s in kids[c]) for c in birth
        }
    chosen: set[int] = set()
    for c in sorted((c for c in birth if c), reverse=True):
        below = sum(mass[k] for k, _, _ in kids[c])
        if kids[c] and below > mass[c]:
            mass[c] = below
        else:
            todo = [k for k, _, _ in kids[c]]
            while todo:
                k = todo.pop()
                chosen.discard(k)
                todo += [x for x, _, _ in kids[k]]
            chosen.add(c)
    names = {c: i for i, c in enumerate(sorted(chosen))}
    labels = np.full(n, -1)
    for c in birth:
        owner = c
        while owner and owner not in chosen:
            owner = parent[owner]
        if owner in names:
            for p, _ in leaves[c]:
                labels[p] = names[owner]
    return labels


CLUSTERERS = {"MeanShift": mean_shift, "HDBSCAN": density_clusters}

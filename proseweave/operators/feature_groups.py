"""Groups of related features. Rows are reduced by Spark to p x p (or k x p) tables; only those reach
the driver. The factor methods return (component, feature, loading, selected)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .regression import moments
from .stats import correlation_matrix

LOADINGS = "component string, feature string, loading double, selected boolean"


def _table(df: DataFrame, prefix: str, columns: list[str], load: np.ndarray, threshold: float) -> DataFrame:
    rows = [
        (f"{prefix}{i + 1}", c, float(load[i, j]), bool(abs(load[i, j]) > threshold)) for i in range(len(load)) for j, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, LOADINGS)


def by_clustering(df: DataFrame, columns: list[str], threshold: float = 1.5, method: str = "kendall", n_clusters: int | None = None) -> DataFrame:
    """(feature, cluster, leaf): average linkage on 1 - |r|, cut at a distance or at a number of clusters;
    ``leaf`` orders the matrix."""
    m = {(r["a"], r["b"]): 1.0 if r["distance"] is None else r["distance"] for r in correlation_matrix(df, columns, method).collect()}
    groups = {i: [c] for i, c in enumerate(columns)}
    merges: list[tuple[float, int, int, int]] = []
    live, nxt = set(groups), len(columns)
    gap = lambda a, b: float(np.mean([m[x, y] for x in groups[a] for y in groups[b]]))
    while len(live) > 1:
        d, a, b = min((gap(a, b), a, b) for a in live for b in live if a < b)
        groups[nxt] = groups[a] + groups[b]
        merges.append((d, a, b, nxt))
        live = (live - {a, b}) | {nxt}
        nxt += 1
    order = groups[nxt - 1] if columns else []
    flat = {c: [c] for c in columns}
    left = len(columns)
    for d, a, b, g in merges:
        if (n_clusters and left <= n_clusters) or (not n_clusters and d > threshold):
            break
        for c in groups[g]:
            flat[c] = groups[g]
        left -= 1
    ids: dict[str, int] = {}
    rows = []
    for c in columns:
        ids.setdefault(flat[c][0], len(ids) + 1)
        rows.append((c, ids[flat[c][0]], order.index(c)))
    return df.sparkSession.createDataFrame(rows, "feature string, cluster int, leaf int")


def by_pca(df: DataFrame, columns: list[str], n: int = 2, threshold: float = 0.4) -> DataFrame:
    values, vectors = np.linalg.eigh(moments(df, columns).cov)
    load = vectors[:, ::-1].T[:n]
    signs = np.sign(load[np.arange(len(load)), np.abs(load).argmax(axis=1)])
    return _table(df, "PC", columns, load * signs[:, None], threshold)


def by_factor_analysis(df: DataFrame, columns: list[str], n: int = 2, threshold: float = 0.4, tol: float = 1e-2, steps: int = 1000) -> DataFrame:
    """Maximum-likelihood factors from the covariance matrix."""
    mo = moments(df, columns)
    cov, tiny = mo.cov, 1e-12
    noise, last = np.ones(len(columns)), -np.inf
    load = np.zeros((n, len(columns)))
    for _ in range(steps):
        root = np.sqrt(noise) + tiny
        values, vectors = np.linalg.eigh(cov / np.outer(root, root))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        load = np.sqrt(np.maximum(values[:n] - 1, 0))[:, None] * vectors[:, :n].T * root
        fit = -mo.n / 2 * (np.log(np.maximum(values[:n], tiny)).sum() + n + values[n:].sum() + np.log(noise).sum())
        if fit - last < tol:
            break
        last = fit
        noise = np.maximum(np.diag(cov) - (load**2).sum(axis=0), tiny)
    return _table(df, "Factor", columns, load, threshold)


def _batch_sums(df: DataFrame, columns: list[str], fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``fn(block)`` over all rows: each partition folds its batches into one row of ``size``
    numbers, Spark adds the rows up, the driver receives ``size`` numbers."""

    def fold(batches):
        total = np.zeros(size)
        for pdf in batches:
            total += fn(pdf.to_numpy(dtype=float)).ravel()
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    rows = df.select(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    sums = rows.mapInPandas(fold, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in sums:
        out[r["i"]] = r["v"]
    return out


def by_ica(df: DataFrame, columns: list[str], n: int = 2, threshold: float = 0.4, steps: int = 200, tol: float = 1e-4, seed: int = 0) -> DataFrame:
    """Symmetric fixed-point ICA (log-cosh). Every step is one aggregate over a stored copy of the columns."""
    df = cut_lineage(df.select(*[F.col(f"`{c}`") for c in columns]))
    mo = moments(df, columns)
    values, vectors = np.linalg.eigh(mo.cov)
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
    white = (vectors / np.sqrt(np.maximum(values, 1e-300))).T  # n x p, rows give unit-variance scores
    mean, p = mo.mean, len(columns)

    def even(w):
        s, u = np.linalg.eigh(w @ w.T)
        return u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-300))) @ u.T @ w

    w = even(np.random.default_rng(seed).normal(size=(n, n)))
    for _ in range(steps):

        def part(x, w=w):
            z = (x - mean) @ white.T
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g**2).sum(axis=0)])

        s = _batch_sums(df, columns, part, n * n + n) / mo.n
        new = even(s[: n * n].reshape(n, n) - s[n * n :][:, None] * w)
        moved = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
        w = new
        if moved < tol:
            break
    return _table(df, "IC", columns, w @ white, threshold)


def by_nmf(df: DataFrame, columns: list[str], n: int = 2, threshold: float = 0.4, steps: int = 60, inner: int = 30, tol: float = 1e-4, seed: int = 0) -> DataFrame:
    """Non-negative factors. The row weights are a function of (row, factors) and are recomputed inside
    each pass over a stored copy of the columns, so nothing row-sized is stored between steps."""
    df = cut_lineage(df.select(*[F.col(f"`{c}`") for c in columns]))
    low = df.agg(*[F.min(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    if any(v is not None and v < 0 for v in low):
        raise ValueError("negative values: shift the columns first")
    p = len(columns)
    h = np.abs(np.random.default_rng(seed).normal(size=(n, p)))
    h *= np.maximum(moments(df, columns).mean, 1e-12) / h.mean(axis=0)
    for _ in range(steps):

        def part(x, h=h):
            hh, xh = h @ h.T, x @ h.T
            w = np.full((len(x), n), np.sqrt(np.maximum(x.mean(), 1e-12) / n))
            for _ in range(inner):
                w *= xh / np.maximum(w @ hh, 1e-12)
            return np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel()])

        s = _batch_sums(df, columns, part, n * p + n * n)
        wx, ww = s[: n * p].reshape(n, p), s[n * p :].reshape(n, n)
        old = h
        for _ in range(inner):
            h = h * wx / np.maximum(ww @ h, 1e-12)
        if np.abs(h - old).max() <= tol * np.abs(old).max():
            break
    return _table(df, "NMF", columns, h, threshold)

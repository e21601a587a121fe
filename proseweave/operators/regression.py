"""Least squares from one moment matrix.

Spark aggregates means and covariances (stable one-pass merges) for the p columns; the driver solves
p x p systems. Every subset model comes from the same matrix, the data is not read again.
"""

from __future__ import annotations

import math
from itertools import chain, combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails as T
from .stats import _num


class Moments:
    """Row count, means and covariance matrix of some columns over complete rows."""

    def __init__(self, columns: list[str], n: int, mean: np.ndarray, cov: np.ndarray):
        self.columns, self.n, self.mean, self.cov = columns, n, mean, cov

    def pick(self, names: list[str]) -> np.ndarray:
        return np.array([self.columns.index(c) for c in names], dtype=int)

    def r2(self, y: str, xs: list[str]) -> float:
        if not xs:
            return 0.0
        i, j = self.pick(xs), self.columns.index(y)
        b = np.linalg.lstsq(self.cov[np.ix_(i, i)], self.cov[i, j], rcond=None)[0]
        return float(b @ self.cov[i, j] / self.cov[j, j])

    def solve(self, y: str, xs: list[str]) -> tuple[np.ndarray, float]:
        i, j = self.pick(xs), self.columns.index(y)
        b = np.linalg.lstsq(self.cov[np.ix_(i, i)], self.cov[i, j], rcond=None)[0]
        return b, float(self.mean[j] - b @ self.mean[i])


def moment_columns(columns: list[str], complete: Column, tag: str = "") -> list[Column]:
    v = {c: F.when(complete, _num(c)) for c in columns}
    out = [F.count(F.when(complete, 1)).alias(f"{tag}n")]
    out += [F.avg(v[c]).alias(f"{tag}m{i}") for i, c in enumerate(columns)]
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            out.append(F.covar_pop(v[a], v[columns[j]]).alias(f"{tag}c{i}_{j}"))
    return out


def read_moments(row, columns: list[str], tag: str = "") -> Moments:
    p = len(columns)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"{tag}c{i}_{j}"] or 0.0
    return Moments(columns, row[f"{tag}n"], np.array([row[f"{tag}m{i}"] or 0.0 for i in range(p)]), cov)


def complete_rows(columns: list[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & _num(c).isNotNull()
    return ok


def moments(df: DataFrame, columns: list[str]) -> Moments:
    return read_moments(df.agg(*moment_columns(columns, complete_rows(columns))).first(), columns)


def hierarchical_ols(df: DataFrame, y: str, domains: list[str], covariates: list[str] | None = None) -> dict[str, DataFrame]:
    """``coefficients``, ``added`` (R2 without and with the domain block) and ``residuals`` (the input
    plus ``semantic_residual``). The base model uses the rows complete for the covariates."""
    cov = covariates or []
    xs = cov + domains
    row = df.agg(
        *moment_columns([y, *cov], complete_rows([y, *cov]), "b_"), *moment_columns([y, *xs], complete_rows([y, *xs]), "f_")
    ).first()
    base, full = read_moments(row, [y, *cov], "b_"), read_moments(row, [y, *xs], "f_")
    b, intercept = full.solve(y, xs)
    i = full.pick(xs)
    r2 = full.r2(y, xs)
    dof = full.n - len(xs) - 1
    sigma2 = full.cov[0, 0] * (1 - r2) * full.n / dof
    inv = np.linalg.pinv(full.cov[np.ix_(i, i)]) / full.n
    se = [math.sqrt(sigma2 * (1 / full.n + full.mean[i] @ inv @ full.mean[i]))] + [math.sqrt(max(sigma2 * v, 0)) for v in np.diag(inv)]
    half = T.t_quantile(0.025, dof)
    rows = []
    for term, est, s in zip(["const", *xs], [intercept, *b], se):
        t = est / s if s > 0 else math.inf
        rows.append((term, *(float(v) for v in (est, s, t, T.t_two_sided(t, dof), est - half * s, est + half * s))))
    spark = df.sparkSession
    fitted = F.lit(float(intercept))
    for c, w in zip(xs, b):
        fitted = fitted + F.lit(float(w)) * _num(c)
    r2_base = base.r2(y, cov)
    return {
        "coefficients": spark.createDataFrame(rows, "term string, coef double, std_err double, t double, p_val double, ci_low double, ci_high double"),
        "added": spark.createDataFrame([("syntax_block", r2_base, r2, r2 - r2_base)], "term string, R2_base double, R2_full double, delta_R2 double"),
        "residuals": df.withColumn("semantic_residual", _num(y) - fitted),
    }


def marginal_r2(df: DataFrame, y: str, xs: list[str], covariates: list[str] | None = None, weighted: bool = False) -> DataFrame:
    """Average gain in R2 of each predictor over all subsets of the others, plus the total R2. The plain
    mean over subsets is the default; ``weighted`` gives true Shapley weights, which sum to the total."""
    cov = covariates or []
    m = moments(df, [y, *cov, *xs])
    fits: dict[frozenset, float] = {}

    def fit(s) -> float:
        key = frozenset(s)
        if key not in fits:
            fits[key] = m.r2(y, cov + sorted(key))
        return fits[key]

    rows = []
    for x in xs:
        rest = [c for c in xs if c != x]
        gain = weight = 0.0
        for s in chain.from_iterable(combinations(rest, k) for k in range(len(rest) + 1)):
            w = 1.0 / math.comb(len(rest), len(s)) if weighted else 1.0
            gain += w * (fit((*s, x)) - fit(s))
            weight += w
        rows.append((x, gain / weight, fit(xs)))
    rows.sort(key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(rows, "predictor string, contribution double, total_R2 double")


def variance_report(df: DataFrame, y: str, domains: list[str], covariates: list[str] | None = None) -> dict[str, DataFrame]:
    """Spearman correlations, added variance, coefficients, residuals and R2 shares together."""
    from .stats import correlation_table

    corr = correlation_table(df, [y], domains, None, "spearman").orderBy(F.desc_nulls_last("r"))
    return {"correlations": corr, **hierarchical_ols(df, y, domains, covariates), "shares": marginal_r2(df, y, domains, covariates)}

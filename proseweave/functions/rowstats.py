"""Row-wise mean, sample deviation and confidence half-width over groups of columns.

Plain arithmetic on the columns, so the whole group compiles into one generated stage.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _clean(cols: list[Column]) -> list[Column]:
    return [F.when(~F.isnan(c.cast("double")), c.cast("double")) for c in cols]


def _count(xs: list[Column]) -> Column:
    return reduce(add, [x.isNotNull().cast("int") for x in xs])


def _sum(xs: list[Column]) -> Column:
    return reduce(add, [F.coalesce(x, F.lit(0.0)) for x in xs])


def row_mean(cols: list[Column]) -> Column:
    xs = _clean(cols)
    return _sum(xs) / F.nullif(_count(xs), F.lit(0))


def row_std(cols: list[Column]) -> Column:
    """Sample deviation over the values present, null with fewer than two. Values are shifted by the
    first one present, which keeps the one-pass formula exact for near-constant rows."""
    xs = _clean(cols)
    base, n = F.coalesce(*xs), _count(xs)
    gaps = [x - base for x in xs]
    s1, s2 = _sum(gaps), _sum([g * g for g in gaps])
    return F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / F.when(n > 1, n - 1))


def row_ci(cols: list[Column], z: float = 1.96) -> Column:
    """z * deviation / sqrt(k) with k the number of columns, not of values present."""
    return F.lit(z) * row_std(cols) / F.lit(float(len(cols)) ** 0.5)


def add_row_stats(df: DataFrame, specs: list[tuple[list[str], str, str | None, str | None]], z: float = 1.96) -> DataFrame:
    """Add (mean, deviation, ci) columns for many column groups at once; a None name is left out.

    Cleaned values, means and deviations are separate projections: each is computed once per row and the
    next one refers to it, so the work stays linear in the number of columns.
    """
    keep = df.columns
    used = list(dict.fromkeys(c for cols, *_ in specs for c in cols))
    tmp = {c: f"_x{i}" for i, c in enumerate(used)}
    out = df.withColumns({tmp[c]: _clean([F.col(f"`{c}`")])[0] for c in used})
    xs = [[F.col(tmp[c]) for c in cols] for cols, *_ in specs]
    out = out.withColumns({f"_m{i}": _sum(x) / F.nullif(_count(x), F.lit(0)) for i, x in enumerate(xs)})
    dev = {}
    for i, x in enumerate(xs):
        gaps = [v - F.col(f"_m{i}") for v in x]
        dev[f"_s{i}"] = F.sqrt(_sum([g * g for g in gaps]) / F.when(_count(x) > 1, _count(x) - 1))
    out = out.withColumns(dev)
    final, names = [], set()
    for i, (cols, mean, std, ci) in enumerate(specs):
        final.append(F.col(f"_m{i}").alias(mean))
        if std:
            final.append(F.col(f"_s{i}").alias(std))
        if ci:
            final.append((F.lit(z / float(len(cols)) ** 0.5) * F.col(f"_s{i}")).alias(ci))
        names |= {mean, std, ci}
    return out.select(*[F.col(f"`{c}`") for c in keep if c not in names], *final)

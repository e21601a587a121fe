"""Syntactic complexity domains from a table of counts and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowstats import row_mean
from ..functions.text import safe_ratio

# Derived means and the components of each domain.
LENGTH_MEANS = {"MLS": ("W", "S"), "MLT": ("W", "T"), "MLC": ("W", "C")}
DOMAINS = {
    "Length": ["MLS", "MLT", "MLC"],
    "Global": ["T/S"],
    "Clausal": ["C/T", "DC/C", "DC/T"],
    "Phrasal": ["VP/T", "CP/T", "CP/C", "CN/T", "CN/C"],
}


def _q(name: str):
    return F.col(f"`{name}`")


def length_means(df: DataFrame) -> DataFrame:
    """MLS, MLT, MLC; a missing count column counts as missing everywhere."""
    pick = lambda c: _q(c) if c in df.columns else F.lit(None).cast("double")
    return df.withColumns({out: safe_ratio(pick(a), pick(b)) for out, (a, b) in LENGTH_MEANS.items()})


def zscores(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """(x - mean) / sample deviation; the moments are one aggregated row, read as a scalar subquery."""
    clean = {c: F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double")) for c in columns}
    stats = df.agg(
        *[F.avg(x).alias(f"_m_{i}") for i, x in enumerate(clean.values())],
        *[F.stddev_samp(x).alias(f"_s_{i}") for i, x in enumerate(clean.values())],
    )
    one = stats.select(F.struct("*").alias("s")).scalar()  # scalar subquery: no join
    return df.withColumns(
        {f"{prefix}{c}": (x - one[f"_m_{i}"]) / F.nullif(one[f"_s_{i}"], F.lit(0.0)) for i, (c, x) in enumerate(clean.items())}
    )


def domain_scores(df: DataFrame) -> DataFrame:
    """Length, Global, Clausal and Phrasal: mean of the available z-scores."""
    full = length_means(df)
    parts = [c for cols in DOMAINS.values() for c in cols]
    full = full.withColumns({c: F.lit(None).cast("double") for c in parts if c not in full.columns})
    scored = zscores(full, parts)
    return scored.withColumns({d: row_mean([_q(f"z_{c}") for c in cols]) for d, cols in DOMAINS.items()})

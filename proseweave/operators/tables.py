"""Table-level helpers: joins by subject or text, updates, summaries, samples, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowstats import numeric_columns
from .ordered import exact_quantiles, melt, smallest_by_hash


def paired_conditions(df: DataFrame, key: str, condition: str, left: str, right: str) -> DataFrame:
    """Inner self-join of two conditions on the subject; clashing columns get the condition as suffix."""
    cols = [c for c in df.columns if c not in (key, condition)]
    side = lambda name: df.where(F.col(condition) == name).select(key, *[F.col(c).alias(f"{c}_{name}") for c in cols])
    return side(left).join(side(right), key)


def subject_means(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def with_scores(means: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Left join of subject means with the distinct score rows."""
    return means.join(scores.dropDuplicates(), key, "left")


def _counted(df: DataFrame, count: str) -> DataFrame:
    """Distinct rows and how often each occurs; equal rows are counted before they travel."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(count))


def merged_counts(features: DataFrame, syntax: DataFrame, on: str, keep: list[str] | None = None, count: str = "n") -> DataFrame:
    """Inner join on the text itself, as distinct rows with the number of times each stands in the join.

    Texts meet on a 128-bit digest and their length, and are then compared as they are. Equal rows of a side are one row
    with a count, so k copies on either side make one row and not k * k. Rows without a text match nothing; columns that
    both sides have, other than ``on``, are taken from ``features``."""
    wanted = [c for c in (syntax.columns if keep is None else keep) if c != on and c not in features.columns]
    key = [F.md5(F.col(on)).alias("_digest"), F.length(on).alias("_length")]
    left = _counted(features.where(F.col(on).isNotNull()), "_left").select("*", *key)
    right = _counted(syntax.where(F.col(on).isNotNull()).select(on, *wanted), "_right").select("*", *key).withColumnRenamed(on, "_text")
    met = left.join(right, ["_digest", "_length"]).where(F.col(on) == F.col("_text"))
    return met.select(on, *[c for c in features.columns if c != on], *wanted, (F.col("_left") * F.col("_right")).alias(count))


def merge_on_text(features: DataFrame, syntax: DataFrame, on: str, keep: list[str] | None = None) -> DataFrame:
    """Inner join on the text itself; repeated texts multiply, when the rows are asked for (see ``merged_counts``)."""
    counted = merged_counts(features, syntax, on, keep, "_n")
    rows = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return rows.drop("_n", "_copy")


def aligned_update(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite cells by key where ``other`` has a value."""
    right = other.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(right, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def side_by_side(frames: list[DataFrame], key: str) -> DataFrame:
    """Columns of several frames next to each other, matched by key and never by row order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def summary_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row per column."""
    long = melt(df, [], columns).where("value is not null and not isnan(value)")
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return basic.join(exact_quantiles(long, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "feature")


def top_by(df: DataFrame, metric: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(metric), *ties).limit(k)


def top_absolute(df: DataFrame, metric: str, k: int = 20, *ties: str) -> DataFrame:
    """The k largest magnitudes, then by signed value."""
    return df.orderBy(F.desc(F.abs(metric)), *ties).limit(k).orderBy(F.desc(metric), *ties)


def fixed_sample(df: DataFrame, n: int, row_id: str, seed: str = "42") -> DataFrame:
    """n random rows, the same for any partitioning. Small n: the rows with the smallest md5."""
    return smallest_by_hash(df, None, row_id, F.lit(n), seed)


def shuffled(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Random order by md5 of the row id: the same for any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(seed))), row_id)


def stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def difference_report(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, column, left, right, gap): cells of the common numeric columns that differ by more than
    ``tolerance``."""
    common = [c for c in numeric_columns(a) if c in numeric_columns(b) and c != key]
    left, right = a.select(key, *common), b.select(key, *[F.col(c).alias(f"_r_{c}") for c in common])
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("left"), F.col(f"_r_{c}").cast("double").alias("right")) for c in common]
    )
    out = left.join(right, key).select(key, F.inline(cells)).withColumn("gap", F.abs(F.col("left") - F.col("right")))
    return out.where(F.col("gap") > tolerance)


def widen_struct(df: DataFrame, column: str) -> DataFrame:
    """Struct column to plain columns."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")

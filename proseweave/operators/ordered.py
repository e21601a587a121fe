"""Ranks, running sums, next-row and exact quantiles over data of any size and skew.

A plain ``rank() over (partition by feature order by value)`` puts a whole feature on one task.
Here equal values are first counted (with map-side combine, so a value holding a third of all
rows shrinks to one row), the counted values are dealt in ranges of (group, value), as many as the
session has shuffle partitions, and each range is sorted apart. The offset of a range is a sum over
the ranges before it, one row each. The dealt ranges are stored, so a stage that runs again after
the loss of an executor sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


#: Ranks of a column that are broadcast (about 16 bytes each).
FEW_RANKS = 10_000


def in_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt in ranges of ``keys`` and stored; ``_part`` numbers the ranges in order."""
    return cut_lineage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))


def rank_table(long: DataFrame, group: str = "feature", value: str = "value") -> DataFrame:
    """One row per (group, value): ``n`` equal rows, ``before`` rows below, ``total`` rows of the
    group, ``avg_rank`` (1-based, ties averaged). Nulls and NaN are left out; a null group is a group."""
    clean = long.select(group, F.col(value).cast("double").alias(value)).where(
        F.col(value).isNotNull() & ~F.isnan(value)
    )
    counts = in_ranges(clean.groupBy(group, value).agg(F.count(F.lit(1)).alias("n")), group, value)
    totals = counts.groupBy(group, "_part").agg(F.sum("n").alias("_pn"))
    by_part = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("_og"),
        F.col("_part").alias("_op"),
        F.coalesce(F.sum("_pn").over(by_part), F.lit(0)).alias("_offset"),
        F.sum("_pn").over(W.partitionBy(group)).alias("total"),
    )
    inside = W.partitionBy(group, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.col("_inner"), F.lit(0))
    return (
        counts.withColumn("_inner", F.sum("n").over(inside))
        .join(offsets, F.col(group).eqNullSafe(F.col("_og")) & (F.col("_part") == F.col("_op")))
        .select(group, value, "n", before.alias("before"), "total", (before + (F.col("n") + 1) / 2).alias("avg_rank"))
    )


def exact_quantiles(long: DataFrame, probs: dict[str, float], group: str = "feature", value: str = "value") -> DataFrame:
    """Exact linear-interpolation quantiles from counted values: one row per group, one column per name in ``probs``."""
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        low, frac = F.floor(pos), pos - F.floor(pos)
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        at_low = F.max(F.when(holds(low), F.col(value)))
        at_high = F.max(F.when(holds(F.least(low + 1, F.col("total") - 1)), F.col(value)))
        f = F.max(F.when(holds(low), frac))
        out.append((at_low + (at_high - at_low) * f).alias(name))
    return rank_table(long, group, value).groupBy(group).agg(*out)


def text_ranks(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """(column, out): 0-based sorted position of every distinct text."""
    words = in_ranges(df.select(column).where(F.col(column).isNotNull()).distinct(), column)
    totals = words.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(column))
    return words.withColumn("_r", inside).join(offsets, "_part").select(column, (F.col("_o") + F.col("_r") - 1).alias(out))


def numbered(df: DataFrame, *order: str, out: str = "number") -> DataFrame:
    """Add ``out``: the row's 0-based number in the order of ``order``, which tells rows apart. Ranges are numbered apart."""
    dealt = in_ranges(df, *order)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return cut_lineage(dealt.withColumn("_r", inside).join(offsets, "_part").select(*df.columns, (F.col("_o") + F.col("_r") - 1).alias(out)))


def with_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add average ranks (``columns``: source -> new name); null where the value is missing.

    One rank pass for all columns, stored, then one equi-join per column on the value. Values that many rows share never are
    keys of a shuffle: a column's ranks are broadcast if there are at most ``FEW_RANKS`` of them, and of another column those
    of the ``FEW_RANKS`` most frequent values; only rows of its rarer values are dealt by value.
    """
    ranks = cut_lineage(rank_table(melt(df, [], list(columns))))
    sizes = {r["feature"]: r["n"] for r in ranks.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    # the wide ones first, while the rows are narrow
    for c, new in sorted(columns.items(), key=lambda item: -sizes.get(item[0], 0)):
        r = ranks.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col("avg_rank").alias(new), "n")
        x = F.col(f"`{c}`").cast("double")
        if sizes.get(c, 0) <= FEW_RANKS:
            out = out.join(F.broadcast(r.drop("n")), x == F.col("_v"), "left").drop("_v")
            continue
        often = r.orderBy(F.desc("n"), "_v").limit(FEW_RANKS).select(F.col("_v").alias("_often"), F.col(new).alias("_often_rank"))
        out = out.join(F.broadcast(often), x == F.col("_often"), "left")
        # a row that has its rank, or no value, gets a key of its own kind that spreads over all tasks
        rare = F.when(F.col("_often").isNull(), x)
        dealt = out.withColumn("_rare", rare).withColumn("_deal", F.when(F.col("_rare").isNull() | F.isnan("_rare"), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long")))
        keyed = r.select("_v", new, F.lit(-1).cast("long").alias("_one"))
        met = dealt.join(keyed, (F.col("_rare") == F.col("_v")) & (F.col("_deal") == F.col("_one")), "left")
        out = met.withColumn(new, F.coalesce("_often_rank", new)).drop("_v", "_one", "_rare", "_deal", "_often", "_often_rank")
    return out.select(*df.columns, *columns.values())


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; all value columns become double."""
    return df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, name, value
    )


# --- order inside a story ------------------------------------------------------------------

BLOCK = 1024


def next_row(df: DataFrame, key: str, pos: str, carry: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Add columns of the following row (``carry``: source -> new name) in order of ``pos`` within
    ``key``. Positions must be unique per key, gaps are fine.

    Work is split into blocks of ``block`` positions, so a key that holds a third of the table is
    spread over many tasks. Only the first row of each block meets its neighbours of other blocks.
    """
    names = list(carry)
    blocked = df.withColumn("_b", F.floor(F.col(pos) / block))
    inner = W.partitionBy(key, "_b").orderBy(pos)
    packed = F.struct(*[F.col(c) for c in names])
    led = blocked.withColumn("_next", F.lead(packed).over(inner))
    heads = blocked.groupBy(key, "_b").agg(F.min_by(packed, F.col(pos)).alias("_head"))
    follow = heads.select(
        key, "_b", F.lead("_head").over(W.partitionBy(key).orderBy("_b")).alias("_over")
    ).where("_over is not null")
    joined = led.join(follow, [key, "_b"], "left")
    nxt = F.coalesce("_next", "_over")
    return joined.select(*df.columns, *[nxt[c].alias(new) for c, new in carry.items()])


def running_sum(df: DataFrame, key: str, pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running sum of ``value`` by ``pos`` within ``key``, blocked like ``next_row``."""
    blocked = df.withColumn("_b", F.floor(F.col(pos) / block))
    inner = W.partitionBy(key, "_b").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    sums = blocked.groupBy(key, "_b").agg(F.sum(value).alias("_s"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(key, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_o"))
    return (
        blocked.withColumn("_in", F.sum(value).over(inner))
        .join(offsets, [key, "_b"])
        .select(*df.columns, (F.col("_in") + F.col("_o")).alias(out))
    )


def dense_positions(df: DataFrame, key: str, order: str, out: str = "pos") -> DataFrame:
    """0-based position without gaps by a unique integer ``order`` within ``key``."""
    counted = running_sum(df.withColumn("_one", F.lit(1.0)), key, order, "_one", "_run")
    return counted.withColumn("_p", (F.col("_run") - 1).cast("bigint")).drop("_one", "_run").select(
        *[c for c in df.columns if c != out], F.col("_p").alias(out)
    )


def smallest_by_hash(df: DataFrame, group: str | None, row_id: str, k: Column, seed: str) -> DataFrame:
    """Keep the ``k`` rows per group with the smallest md5 of (id, seed); ``k`` may use ``_total``
    (rows of the group). md5 is uniform, so its first 16 bits are equal-size buckets: whole
    buckets below the cut pass, and only rows of the cut bucket are ranked. ``row_id`` is unique.
    """
    g = F.lit(0) if group is None else F.col(group)
    tagged = df.withColumn("_g", g).withColumn(
        "_h", F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(seed)))
    )
    tagged = tagged.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    totals = tagged.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    plan = totals.select(
        "_g",
        "_b",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy("_g")).alias("_total"),
    ).withColumn("_k", k)
    plan = plan.where(F.col("_before") < F.col("_k"))
    joined = tagged.join(plan, ["_g", "_b"])
    whole = joined.where(F.col("_before") + F.col("_n") <= F.col("_k")).select(*df.columns)
    cut = joined.where(F.col("_before") + F.col("_n") > F.col("_k"))
    ranked = cut.withColumn(
        "_r", F.row_number().over(W.partitionBy("_g", "_b").orderBy("_h", row_id))
    ).where(F.col("_before") + F.col("_r") <= F.col("_k"))
    return whole.unionByName(ranked.select(*df.columns))

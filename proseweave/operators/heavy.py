"""Heavy hitters of a column: a mergeable Misra-Gries summary, and joins that treat them apart from the tail.

Each task keeps at most ``2 * capacity`` counters over its batches and hands on at most ``capacity``; the summaries of all
tasks are added. A value that holds more than 1 / (capacity + 1) of a task's rows is never lost, and a count is too low by
at most that share. Nothing here decides a result: a summary only says which way a value is joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024


class Summary:
    """Misra-Gries counters, reduced whenever twice the capacity is reached."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.counts = capacity, Counter()

    def add(self, values: Iterable) -> None:
        """Count a bounded batch of values."""
        self.counts.update(values)
        if len(self.counts) > 2 * self.capacity:
            self.reduce()

    def reduce(self) -> None:
        """Take the (capacity + 1)-th largest count from all, so at most ``capacity`` stay above nothing."""
        if len(self.counts) > self.capacity:
            cut = sorted(self.counts.values(), reverse=True)[self.capacity]
            self.counts = Counter({v: n - cut for v, n in self.counts.items() if n > cut})


def summary_of(df: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """(value, n): heavy values of ``column`` with lower bounds of their counts; nulls are not counted."""
    kind = df.schema[column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, form = Summary(capacity), None
        for batch in batches:
            form = batch.column(0).type
            values, counts = batch.column(0).drop_null().value_counts().flatten()
            seen.add(dict(zip(values.to_pylist(), counts.to_pylist(), strict=True)))
        seen.reduce()
        if seen.counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.counts), form), pa.array(list(seen.counts.values()), pa.int64())], names=["value", "n"])

    parts = df.select(F.col(column).alias("value")).mapInArrow(run, f"value {kind.simpleString()}, n long")
    return parts.groupBy("value").agg(F.sum("n").alias("n"))


def heavy_values(df: DataFrame, column: str, share: float, capacity: int = CAPACITY) -> list:
    """Values of ``column`` that hold about ``share`` of its rows or more, at most 1 / share of them (a bounded list)."""
    if share * (capacity + 1) <= 1:
        raise ValueError("the capacity is too small for this share")
    total = df.select(F.count(column).alias("n")).scalar()
    # a count is a lower bound, short by at most 1 / (capacity + 1) of all rows
    least = F.lit(share - 1 / (capacity + 1)) * total
    rows = summary_of(df, column, capacity).where(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(int(1 / share) + 1).collect()
    return [r["value"] for r in rows]


def split_join(df: DataFrame, table: DataFrame, on: str, columns: list[str], share: float = 0.002, how: str = "left") -> DataFrame:
    """``df`` joined with the rows of ``table`` that have its value of ``on`` (left or inner), whatever the skew of ``on``.

    Values that hold ``share`` of the rows or more are joined by a broadcast of their few table rows: at most
    1 / share + 1 keys, which are unique in ``table`` (checked). All others are joined as Spark sees fit; in a shuffle none of
    them can fill a task. Rows with a null ``on`` never travel. ``columns`` of ``table`` are added. ``df`` is read twice."""
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    hot = heavy_values(df, on, share)
    right = table.select(on, *columns)
    keyed = df.where(F.col(on).isNotNull())
    if hot:
        is_hot = F.col(on).isin(hot)
        few = right.where(is_hot)
        if few.count() > len(hot):
            raise ValueError(f"{on} must be unique in the joined table")
        parts = keyed.where(is_hot).join(F.broadcast(few), on, how).unionByName(keyed.where(~is_hot).join(right.where(~is_hot), on, how))
    else:
        parts = keyed.join(right, on, how)
    if how == "left":
        nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
        parts = parts.select(*df.columns, *columns).unionByName(df.where(F.col(on).isNull()).select("*", *nothing))
    return parts.select(*df.columns, *columns)


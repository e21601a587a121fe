"""Delimited files with quoted line breaks, read by many tasks a file.

A line begins a record if the number of quotes before it in its file is even. A first pass counts the quotes of each
split of the scan; running sums over the splits, a row for each, say which of them begin inside a quoted field. The second
pass joins the lines of every split to records where they stand; only the pieces of records that cross a split's end, two a
split at most, are shuffled.

Quotes inside a field are doubled, and a field that holds one is quoted, as ``write_delimited`` does. Blank lines between
records are no rows. A quote that is never closed makes the rest of its file one record. The files and
``spark.sql.files.*`` must not change between the passes: a split that the first has not seen is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import cut_lineage

#: Splits up to this number are broadcast to the lines; more are joined by a shuffle.
BROADCAST_SPLITS = 200_000


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line, file, start (of the split) and row, in the order of the file within a split."""
    read = spark.read.text(path, lineSep="\n")
    return read.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def _pieces(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with one value of all keys."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    bounds = [0, *np.flatnonzero(change).tolist(), n]
    yield from zip(bounds[:-1], bounds[1:], strict=True)


def _odd_before(quotes: np.ndarray, odd: bool) -> np.ndarray:
    """Whether the quotes before each line, and at the end, are odd in number."""
    return (np.concatenate([[0], np.cumsum(quotes)]) + odd) % 2 == 1


def _counted(lines: DataFrame) -> DataFrame:
    """file, start, whether the split's quotes are odd in number, and whether a line has an odd number before it in the split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, odd, turned = None, False, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "odd": [odd], "turned": [turned]})

        for batch in batches:
            if not batch.num_rows:
                continue
            quotes = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            file, start = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            for i, j in _pieces([file.indices.to_numpy(), start]):
                here = (file[i].as_py(), int(start[i]))
                if here != at:
                    if at is not None:
                        yield row()
                    at, odd, turned = here, False, False
                before = _odd_before(quotes[i:j], odd)
                turned, odd = turned or bool(before[:-1].any()), bool(before[-1])
        if at is not None:
            yield row()

    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return lines.select(quotes.cast("long").alias("q"), "file", "start").mapInArrow(count, "file string, start long, odd boolean, turned boolean")


def _splits(lines: DataFrame) -> DataFrame:
    """file, start, split (its number), inside (begins within quotes), owner (the split that began the record open there)."""
    counted = cut_lineage(_counted(lines).withColumn("split", F.monotonically_increasing_id()))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    marked = counted.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    # a record stays open at the end of a split that a line of this split began
    opens = (F.col("inside") != F.col("odd")) & (~F.col("inside") | F.col("turned"))
    owner = F.last(F.when(opens, F.col("split")), ignorenulls=True).over(before)
    return cut_lineage(marked.select("file", "start", "split", "inside", owner.alias("owner")))


def _records(lines: DataFrame) -> DataFrame:
    """record, owner, split, header: records where owner is null, else pieces of the record that began in split ``owner``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, owner, first, odd, held, began = None, None, False, False, [], False

        def out(records: list, owner: int | None, header: bool) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.array(records, pa.string()), pa.array([owner] * n, pa.int64()), pa.array([split] * n, pa.int64()), pa.array([header] + [False] * (n - 1), pa.bool_())], names=["record", "owner", "split", "header"]
            )

        def close() -> Iterator[pa.RecordBatch]:
            """What is held at the end of a split: open there, a whole record, or a piece of an earlier one."""
            if held:
                yield out(["\n".join(held)], (split if odd else None) if began else owner, first and began)

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(2)
            if numbers.null_count:
                raise ValueError("the files or their splits changed while they were read")
            numbers = numbers.to_numpy()
            quotes = batch.column(1).to_numpy()
            for i, j in _pieces([numbers]):
                if int(numbers[i]) != split:
                    yield from close()
                    split, odd, owner = int(numbers[i]), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                    first, held, began = batch.column(5)[i].as_py() == 0, [], False
                before = _odd_before(quotes[i:j], odd)
                odd = bool(before[-1])
                starts = np.flatnonzero(~before[:-1])
                values = batch.column(0).slice(i, j - i)
                head = int(starts[0]) if len(starts) else j - i
                if head:
                    held.extend(values.slice(0, head).to_pylist())
                if not len(starts):
                    continue
                if held:
                    yield out(["\n".join(held)], None if began else owner, first and began)
                    first = first and not began
                if len(starts) > 1:
                    runs = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values.cast(pa.string()))
                    yield out(pc.binary_join(runs, "\n").to_pylist(), None, first)
                    first = False
                held, began = values.slice(int(starts[-1])).to_pylist(), True
        yield from close()

    return lines.select("line", "q", "split", "inside", "owner", "start").mapInArrow(work, "record string, owner long, split long, header boolean")


def quoted_records(spark: SparkSession, path: str | list[str], header: bool, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """One row ``record`` for each record of the files, its line breaks kept; the first of each file goes if it is a ``header``."""
    lines = _lines(spark, path)
    splits = _splits(lines)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    lines = lines.withColumn("q", quotes.cast("long"))
    if splits.count() <= broadcast_splits:
        placed = lines.join(F.broadcast(splits), ["file", "start"], "left")
    else:
        placed = lines.join(splits, ["file", "start"], "left").repartition("split").sortWithinPartitions("split", "row")
    # the files are read three times (counts, whole records, pieces), but only the pieces are shuffled
    found = _records(placed)
    whole = found.where("owner is null").select("record", "header")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "split_start", "record"))), lambda p: p["record"]), "\n")
    order = splits.select("split", F.col("start").alias("split_start"))
    pieces = found.where("owner is not null").join(order, "split").withColumn("part", (F.col("split") != F.col("owner")).cast("int"))
    crossing = pieces.groupBy("owner").agg(joined.alias("record"), F.bool_or("header").alias("header")).select("record", "header")
    both = whole.unionByName(crossing)
    both = both.where(~F.col("header")) if header else both
    return both.select(F.regexp_replace("record", r"\r\z", "").alias("record")).where("record <> ''")


def read_quoted(spark: SparkSession, path: str | list[str], sep: str, schema: T.StructType | None = None, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """Files with a header and quoted line breaks, each read by as many tasks as it has splits; strings without a schema."""
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    if schema is None:
        schema = spark.read.options(header=True, **options).csv(path).schema
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return quoted_records(spark, path, True, broadcast_splits).select(F.from_csv("record", columns, options).alias("r")).select("r.*")

"""Resumable enrichment: only rows (or files) without a stored result are processed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.ordered import numbered
from ..session import cut_lineage, ensure_checkpoint_dir

Enrich = Callable[[DataFrame], DataFrame]


def enrich_new_rows(df: DataFrame, enrich: Enrich, path: str, key: str, strict: bool = True) -> int:
    """Enrich the rows whose key is not stored under ``path`` yet and append them. ``strict`` demands one
    output row per input row; the check runs on a stored copy of the result before it is appended."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # a missing or empty folder only
            raise
        stored = None
    todo = cut_lineage(df if stored is None else df.join(stored.select(key), key, "left_anti"))
    result = cut_lineage(enrich(todo))  # a stored copy: what is checked is what is appended
    n_out = result.count()
    if strict:
        n_in, n_keys = todo.count(), result.select(key).distinct().count()
        if not n_in == n_out == n_keys:
            raise ValueError(f"{n_in} rows in, {n_out} rows and {n_keys} keys out")
    if n_out:
        result.write.mode("append").parquet(path)
    return n_out


MANIFEST = T.StructType([T.StructField("batch", T.LongType()), T.StructField("folder", T.StringType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The committed batches under ``path``: number, folder, order number of the first row, rows."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def committed_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of committed batches, or None; ``order_number`` restores the order in which they were taken."""
    folders = [r["folder"] for r in manifest(spark, path).select("folder").collect()]  # one for each batch
    return spark.read.parquet(*[f"{path}/data/{f}" for f in sorted(folders)]) if folders else None


def enrich_in_order(df: DataFrame, enrich: Enrich, path: str, key: str, order: list[str], batch_rows: int = 1_000_000) -> int:
    """Enrich the rows whose key is in no committed batch, batch by batch in the order of ``order``, which tells rows apart.

    A batch is written to a folder of its own; then one line in the manifest commits it. A run that breaks off in between
    leaves a folder that no line names, so its rows are neither lost nor read twice. ``order_number`` goes on from the rows
    committed before. One writer at a time; the enrichment gives one row for each key, which must be unique and not null."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    listed, stored = manifest(spark, path), committed_rows(spark, path)
    batch, done = listed.agg(F.coalesce(F.max("batch") + 1, F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    todo = df if stored is None else df.join(stored.select(key), key, "left_anti")
    dealt = f"{spark.sparkContext.getCheckpointDir()}/batches-{uuid.uuid4()}"
    placed = numbered(todo, *order, out="order_number")
    placed = placed.withColumns({"_batch": F.floor(F.col("order_number") / batch_rows), "order_number": F.col("order_number") + done})
    placed.write.partitionBy("_batch").parquet(dealt)
    total = 0
    sizes = {r["_batch"]: r["count"] for r in spark.read.schema(placed.schema).parquet(dealt).groupBy("_batch").count().collect()}
    for step in range(len(sizes)):
        rows = spark.read.schema(placed.drop("_batch").schema).parquet(f"{dealt}/_batch={step}")
        folder = f"{batch + step}-{uuid.uuid4()}"
        result = enrich(rows.drop("order_number")).join(rows.select(key, "order_number"), key)
        result.write.parquet(f"{path}/data/{folder}")
        found = spark.read.schema(result.schema).parquet(f"{path}/data/{folder}").agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.min("order_number").alias("first")).first()
        if not sizes[step] == found["n"] == found["keys"]:
            raise ValueError(f"{sizes[step]} rows in, {found['n']} rows and {found['keys']} keys out")
        _commit(spark, path, batch + step, folder, found["first"], found["n"])
        total += found["n"]
    return total


def _commit(spark: SparkSession, path: str, batch: int, folder: str, first: int, n: int) -> None:
    spark.createDataFrame([(batch, folder, first, n)], MANIFEST).coalesce(1).write.json(f"{path}/manifest/{folder}")


def run_new_files(spark: SparkSession, source: str, schema: T.StructType, enrich: Enrich, out: str, state: str) -> None:
    """Process the files that arrived since the last run, exactly once, with a row-wise ``enrich``. The
    progress is the stream's checkpoint in ``state``, which must be on storage that all machines share."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        enrich(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()

"""Centroid clustering of whole-number vectors with heap-ordered bounds.

Vectors are packed in blocks. For each block every cluster keeps a heap of its vectors, ordered by the gap between a lower
bound of the distance to the second nearest centroid and an upper bound of that to the own one. Moving centroids shrink the
gaps of a cluster's vectors alike: by the way of its own centroid and the longest way of another. So a vector is pushed with
its gap plus the drift its cluster has accumulated, and only those whose key the drift has reached are popped and rescanned
exactly; no other vector is looked at, and none of them can have another nearest centroid.

Blocks are dealt once, in a bucketed table; a round reads it beside the heaps of the last round, which are bucketed alike, so
nothing but sums is shuffled: each task adds up what moved between its clusters, and ``k * (dims + 1)`` whole numbers in all
reach the driver, which divides them. Every round is a table in the folder of ``spark.checkpoint.dir``; a lost executor
costs its tasks of one round. Distances and sums are whole numbers, so the result does not depend on blocks or order.

Defined cases: vectors that are null, have another number of components or hold a null or non-finite one are left out;
a null id counts as the empty string in the hash and stays null; repeated rows are vectors of their own (equal hashes go
by their components); with fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows;
an empty cluster keeps its centroid; other columns are ignored. Whole numbers so large that a squared distance need not fit
in a long (beyond +-2^27 for 64 components) are an error.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of a block, and blocks of a bucket, about.
BLOCK, BLOCKS_A_BUCKET = 4096, 16
MOST_BUCKETS = 100_000  # Spark's limit
#: Bounds give way by this share, far above the rounding of a double and far below the gap of two whole squares.
SLACK = 1e-12


def usable(vec: Column, dims: int) -> Column:
    """Vectors of the right length without null, NaN and infinite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) == dims) & F.forall(vec, lambda x: finite(x.cast("double"))), F.lit(False))


def start(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Components of the rows with the smallest hashes of their ids (columns id and v), in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        apart = vectors - centroid
        out[:, c] = np.einsum("nd,nd->n", apart, apart)
    return out


@dataclass
class Centroids:
    """Centroids of a round, and the drift that each cluster's gaps have lost since the start."""

    at: np.ndarray
    drift: np.ndarray

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Centroids:
        """Floored means of what the clusters hold; an empty one stays."""
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], self.at)
        way = np.sqrt(((new - self.at) ** 2).sum(axis=1).astype(float))
        others = np.array([np.delete(way, c).max(initial=0.0) for c in range(len(way))])
        return Centroids(new, self.drift + (way + others) * (1 + SLACK))


class Heaps:
    """The heaps of one block: entries (key, row) of each cluster, and each row's cluster (-1 before the first scan)."""

    def __init__(self, cluster: np.ndarray, key: np.ndarray, clusters: int):
        self.cluster, self.key = cluster, key
        rows = [np.flatnonzero(np.maximum(cluster, 0) == c) for c in range(clusters)]
        self.heaps = [list(zip(key[r].tolist(), r.tolist(), strict=True)) for r in rows]
        for heap in self.heaps:
            heapq.heapify(heap)

    @classmethod
    def unscanned(cls, n: int, clusters: int) -> Heaps:
        """All rows expired, so the first scan pops them."""
        return cls(np.full(n, -1), np.full(n, -np.inf), clusters)

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pop the rows whose gap the drift of their cluster has used up."""
        out = []
        for heap, lost in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= lost:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def push(self, rows: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> None:
        self.cluster[rows], self.key[rows] = clusters, keys
        for row, cluster, key in zip(rows.tolist(), clusters.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self.heaps[cluster], (key, row))


def rescan(vectors: np.ndarray, heaps: Heaps, now: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Pop what expired and scan it exactly: those rows and their clusters before."""
    rows = heaps.expired(now.drift)
    before = heaps.cluster[rows]
    if len(rows):
        found, each = squares(vectors[rows], now.at), np.arange(len(rows))
        nearest = found.argmin(axis=1)  # the smaller number of equals
        upper = np.sqrt(found[each, nearest].astype(float))
        found[each, nearest] = np.iinfo(np.int64).max
        lower = np.sqrt(found.min(axis=1).astype(float))
        heaps.push(rows, nearest, lower * (1 - SLACK) - upper * (1 + SLACK) + now.drift[nearest])
    return rows, before


# ---- blocks and rounds as tables

_STATE = "block long, clusters binary, keys binary, moves array<long>, scanned long"


def _packed(vectors: DataFrame, dims: int) -> DataFrame:
    """Blocks of whole vectors (columns id and v)."""
    largest = math.isqrt((1 << 62) // dims) // 2
    listed = T.ArrayType(vectors.schema["id"].dataType).simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, parts, held = itertools.count(TaskContext.get().partitionId() << 32), [], [], 0

        def block() -> pa.RecordBatch:
            column = pa.concat_arrays(ids)
            one = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), one, pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["block", "ids", "vectors"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                whole = some.column(1).flatten().to_numpy().reshape(-1, dims)
                if np.abs(whole).max() > largest:
                    raise ValueError(f"a component is beyond {largest} after scaling")
                ids.append(some.column(0))
                parts.append(whole.astype(np.int32))
                held += some.num_rows
                if held >= BLOCK:
                    yield block()
                    ids, parts, held = [], [], 0
        if held:
            yield block()

    return vectors.select("id", "v").mapInArrow(run, f"block long, ids {listed}, vectors binary")


class Store:
    """Tables of one run under the checkpoint folder, named apart from those of any other run."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.run = spark, uuid.uuid4().hex
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/centroids-{self.run}"

    def bucketed(self, df: DataFrame, name: str, buckets: int) -> DataFrame:
        full = f"centroids_{self.run}_{name}"
        df.write.bucketBy(buckets, "block").option("path", f"{self.folder}/{name}").saveAsTable(full)
        return self.spark.table(full)

    def plain(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        """Forget a bucketed table and remove its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS centroids_{self.run}_{name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _beside(blocks: DataFrame, state: DataFrame | None, *more: str) -> DataFrame:
    """Blocks with their heaps of the last round; both tables are bucketed by the block, so neither is shuffled."""
    own = blocks.select("block", "vectors", *more)
    if state is None:
        nothing = F.lit(None).cast("binary")
        return own.select("block", "vectors", nothing.alias("clusters"), nothing.alias("keys"), *more)
    return own.join(state.select("block", "clusters", "keys").hint("merge"), "block").select("block", "vectors", "clusters", "keys", *more)


def _open(batch: pa.RecordBatch, row: int, dims: int, clusters: int) -> tuple[np.ndarray, Heaps]:
    vectors = np.frombuffer(batch.column(1)[row].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
    assigned, keys = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
    if assigned is None:
        return vectors, Heaps.unscanned(len(vectors), clusters)
    return vectors, Heaps(np.frombuffer(assigned, np.int32).astype(np.int64), np.frombuffer(keys, np.float64).copy(), clusters)


def _round(blocks: DataFrame, state: DataFrame | None, now: Centroids, dims: int) -> DataFrame:
    """The heaps after assigning all vectors to ``now``. The last block of a task carries what the task's vectors moved:
    sums of components and a count for each cluster, end to end."""
    sent = blocks.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = sent.value, None
        moves, scanned = np.zeros((len(now.at), dims + 1), np.int64), 0

        def row(block: int, heaps: Heaps, *more) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64())
            cells = (block, heaps.cluster.astype(np.int32).tobytes(), heaps.key.tobytes(), *more)
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["block", "clusters", "keys", "moves", "scanned"])

        for batch in batches:
            for at in range(batch.num_rows):
                vectors, heaps = _open(batch, at, dims, len(now.at))
                rows, before = rescan(vectors, heaps, now)
                scanned += len(rows)
                after = heaps.cluster[rows]
                whole = np.concatenate([vectors[rows], np.ones((len(rows), 1), np.int64)], axis=1)
                for c in range(len(now.at)):
                    moves[c] += whole[(after == c) & (before != c)].sum(axis=0) - whole[(before == c) & (after != c)].sum(axis=0)
                if last is not None:
                    yield row(*last, None, None)
                last = batch.column(0)[at].as_py(), heaps
        if last is not None:
            yield row(*last, moves.ravel().tolist(), scanned)

    return _beside(blocks, state).mapInArrow(run, _STATE)


def _assigned(blocks: DataFrame, state: DataFrame | None, now: Centroids, dims: int) -> DataFrame:
    """(id, cluster, distance) of every vector at the last centroids."""
    sent = blocks.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                vectors, heaps = _open(batch, at, dims, len(sent.value.at))
                rescan(vectors, heaps, sent.value)
                apart = vectors - sent.value.at[heaps.cluster]
                columns = [batch.column(4)[at].values, pa.array(heaps.cluster.astype(np.int32)), pa.array(np.einsum("nd,nd->n", apart, apart))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return _beside(blocks, state, "ids").mapInArrow(run, f"id {kind}, cluster int, distance long")


@dataclass
class Clustering:
    found: DataFrame  # id, cluster, distance
    centroids: np.ndarray
    inertia: np.ndarray  # of each cluster
    scanned: list[int]  # rows scanned exactly in each round


def cluster(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> Clustering | None:
    """Assign every usable vector after ``rounds`` rounds of floored means; None without one."""
    spark = vectors.sparkSession
    whole = F.transform(F.col(vec), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    kept = vectors.where(usable(F.col(vec), dims)).select(F.col(key).alias("id"), whole.alias("v"))
    now = start(kept, clusters, seed)
    if not len(now):
        return None
    k, store = len(now), Store(spark)
    now = Centroids(now, np.zeros(k))
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, vectors.count() // (BLOCK * BLOCKS_A_BUCKET)))
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    sums, counts, scanned, state = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [], None
    try:
        blocks = store.bucketed(_packed(kept, dims).repartition(buckets, "block"), "blocks", buckets)
        spark.conf.set(limit, str(BLOCKS_A_BUCKET))  # a row is a block here
        for r in range(rounds):
            state = store.bucketed(_round(blocks, state, now, dims), f"round{r}", buckets)
            told = state.where("moves is not null")
            for row in told.select(F.posexplode("moves").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
                c, d = divmod(row["i"], dims + 1)
                if d < dims:
                    sums[c, d] += row["n"]
                else:
                    counts[c] += row["n"]
            scanned.append(told.agg(F.sum("scanned")).first()[0])
            now = now.moved(sums, counts)
            if r:
                store.drop(f"round{r - 1}")
        found = store.plain(_assigned(blocks, state, now, dims), "found")
    finally:
        spark.conf.set(limit, before)
        for name in ("blocks", *[f"round{r}" for r in range(rounds)]):
            store.drop(name)
    inertia = np.zeros(k, np.int64)
    for row in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect():
        inertia[row["cluster"]] = row["n"]
    return Clustering(found, now.at, inertia, scanned)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def assignments(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", **settings) -> DataFrame:
    """Key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    made = cluster(vectors, key, vec, **settings)
    kind = vectors.schema[key].dataType.simpleString()
    if made is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    own = F.get(F.array(*[F.lit(int(x)) for x in made.inertia]), F.col("cluster")).cast("long")
    name = F.get(F.array(*[F.lit(digest(c)) for c in made.centroids]), F.col("cluster"))
    out = made.found.withColumnRenamed("id", key)
    return out.withColumns({"cluster_inertia": own, "inertia": F.lit(int(made.inertia.sum())).cast("long"), "centroid_sha256": name})

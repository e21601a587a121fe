"""Propensity scores and one-to-one matching without replacement."""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import cut_lineage
from .learn import vectorise
from .ordered import in_ranges

#: Rows of a range that one task may hold, about.
RANGE_ROWS = 1 << 18


def propensity(df: DataFrame, treatment: str, covariates: list[str]) -> DataFrame:
    """Add ``logit``: log-odds of treatment from a logistic regression."""
    data = vectorise(df, covariates).withColumn("label", F.col(treatment).cast("double"))
    model = LogisticRegression(maxIter=100, regParam=0.0).fit(data.select("label", "features"))
    return model.transform(data).withColumn("logit", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop(
        "features", "rawPrediction", "probability", "prediction", "label"
    )


def _equal_scores(rows: DataFrame) -> DataFrame:
    """Pairs of rows with exactly the same score: the i-th treated with the i-th control. The rows of one score and arm are
    numbered in ranges of the id, so a score that many rows share is numbered by many tasks."""
    dealt = in_ranges(rows, "s", "t", "id")
    sizes = dealt.groupBy("s", "t", "_part").agg(F.count(F.lit(1)).alias("c"))
    before = W.partitionBy("s", "t").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offs = sizes.select("s", "t", "_part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    inner = W.partitionBy("s", "t", "_part").orderBy("id")
    numbered = dealt.withColumn("r", F.row_number().over(inner)).join(offs, ["s", "t", "_part"]).withColumn("k", F.col("r") + F.col("o"))
    side = lambda t, n: numbered.where(F.col("t") == t).select("s", "k", F.col("id").alias(n))
    return side(1, "treated").join(side(0, "control"), ["s", "k"]).select("treated", "control", F.lit(0.0).alias("gap"))


def pair_hash(treated: str, control: str) -> str:
    """Decides between pairs of one gap."""
    return hashlib.md5(f"{treated}|{control}".encode()).hexdigest()


def settled_pairs(scores: list[float], arms: list[int], names: list[str], caliper: float, below: float, above: float) -> tuple[list[tuple[int, int]], list[int]]:
    """(treated, control) pairs of a range of rows, in order of score, that greedy matching of the whole table makes for
    certain, and the rows that are still open.

    Greedy matching takes the pair of least gap (then least ``pair_hash``) among all neighbours of different arms, again and
    again. ``below`` and ``above`` are the scores of the next rows outside the range, whose fate is unknown. A pair is settled
    when it is the least left and every unknown row is farther from both of its rows than they are from each other; else its
    rows and all between them and that side become unknown, too. So what is settled does not depend on how rows are dealt.
    A row without an unknown one within the caliper that has not been paired never will be: it is not open.

    Rows of one score are of one arm here; the first of them faces down, the last faces up."""
    n = len(scores)
    before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
    heap: list[tuple[float, str, int, int]] = []

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < n and arms[i] != arms[j] and scores[j] - scores[i] <= caliper:
            treated, control = (i, j) if arms[i] else (j, i)
            heapq.heappush(heap, (scores[j] - scores[i], pair_hash(names[treated], names[control]), i, j))

    for i in range(n - 1):
        offer(i, i + 1)
    pairs = []
    while heap:
        gap, _, i, j = heapq.heappop(heap)
        if gone[i] or gone[j] or scores[i] <= below or scores[j] >= above:
            continue
        low, high = scores[i] - below <= gap, above - scores[j] <= gap
        if low or high:
            below, above = scores[j] if low else below, scores[i] if high else above
            continue
        pairs.append((i, j) if arms[i] else (j, i))
        gone[i] = gone[j] = True
        left, right = before[i], after[j]
        if left >= 0:
            after[left] = right
        if right < n:
            before[right] = left
        offer(left, right)
    return pairs, [i for i in range(n) if not gone[i] and (scores[i] - below <= caliper or above - scores[i] <= caliper)]


def _round(rows: DataFrame, caliper: float, parts: int) -> DataFrame:
    """One round over rows (id, t, s, name) dealt in ``parts`` ranges of the score: a row (id, t, s, name, mate, gap) for
    every settled pair, under its treated row, and for every open row, whose mate is null."""
    dealt = cut_lineage(rows.repartitionByRange(parts, "s", "name").withColumn("_part", F.spark_partition_id()))
    # one row for each range
    ends = sorted((r["_part"], r["lo"], r["hi"]) for r in dealt.groupBy("_part").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).collect())
    outside = {p: (ends[k - 1][2] if k else float("-inf"), ends[k + 1][1] if k + 1 < len(ends) else float("inf")) for k, (p, _, _) in enumerate(ends)}
    sent = rows.sparkSession.sparkContext.broadcast(outside)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("s", "ascending"), ("name", "ascending")])
        scores, arms, names = (table.column(c).to_pylist() for c in ("s", "t", "name"))
        pairs, still = settled_pairs(scores, arms, names, caliper, *sent.value[table.column("_part")[0].as_py()])
        out = table.select(["id", "t", "s", "name"]).take(pa.array([i for i, _ in pairs] + still, pa.int64()))
        mates = table.column("id").take(pa.array([j for _, j in pairs] + [None] * len(still), pa.int64()))
        gaps = pa.array([abs(scores[i] - scores[j]) for i, j in pairs] + [None] * len(still), pa.float64())
        return out.append_column("mate", mates).append_column("gap", gaps)

    kind = rows.schema["id"].dataType.simpleString()
    return cut_lineage(dealt.groupBy("_part").applyInArrow(work, f"id {kind}, t int, s double, name string, mate {kind}, gap double"))


def greedy_rounds(rows: DataFrame, caliper: float, range_rows: int = RANGE_ROWS) -> tuple[DataFrame | None, int]:
    """Greedy matching of rows (id, t, s, name) in which equal scores are of one arm: (treated, control, gap) and the number
    of rounds."""
    pairs, rounds = None, 0
    while rows.select("t").distinct().count() == 2:
        # one range more in every other round, so that no two rows are parted for ever
        n = rows.count()
        parts = 1 if n <= range_rows else -(-n // range_rows) + rounds % 2
        found, rounds = _round(rows, caliper, parts), rounds + 1
        new = found.where("gap is not null").select(F.col("id").alias("treated"), F.col("mate").alias("control"), "gap")
        if new.isEmpty():
            range_rows *= 2
        pairs = new if pairs is None else cut_lineage(pairs.unionByName(new))
        rows = found.where("gap is null").drop("mate", "gap")
    return pairs, rounds


def match_nearest(df: DataFrame, row_id: str, treatment: str, score: str, caliper: float = 0.2) -> DataFrame:
    """(treated, control, gap): one-to-one pairs within the caliper, without replacement; ``row_id`` is unique.

    The greedy matching of the whole table: rows of equal scores first, then always the pair of least gap, equal gaps by
    ``pair_hash``. It does not depend on row order or partitions, and no two unmatched rows of different arms are within
    the caliper. Rows without a score are left unmatched.

    Every round deals the open rows in ranges of the score, and a task settles all that its range alone decides, however
    long the chain of dependence inside it is. Only what hangs on rows beyond a range's ends stays open: with ties broken by
    hash that is a few rows at each end (of the order of the logarithm of their number), and the next round's ranges end
    elsewhere. A round that settles nothing doubles the ranges.
    """
    rows = df.select(F.col(row_id).alias("id"), F.col(treatment).cast("int").alias("t"), F.col(score).cast("double").alias("s"))
    rows = cut_lineage(rows.where("t in (0, 1) and s is not null and not isnan(s)").withColumn("name", F.col("id").cast("string")))
    pairs = cut_lineage(_equal_scores(rows.drop("name")))
    rest = cut_lineage(rows.join(pairs.select(F.explode(F.array("treated", "control")).alias("id")), "id", "left_anti"))
    more, _ = greedy_rounds(rest, caliper)
    return pairs if more is None else pairs.unionByName(more)


def filter_rows(df: DataFrame, name: str, covariates: list[str] | None = None, row_id: str = "index") -> tuple[DataFrame, DataFrame]:
    """Apply a named filter (``medium_temperature``, ``high_temperature`` or ``psm``). Returns the rows kept
    and a one-row table (before, after)."""
    if "medium_temperature" in name or "high_temperature" in name:
        band = "medium_temperature" if "medium_temperature" in name else "high_temperature"
        kept = df.where(F.col("temperature_enc") != band)
    elif name == "psm":
        arms = df.withColumn("treatment_1", L.treatment(F.col("combined_label"))).where("treatment_1 <> -1")
        m = match_nearest(propensity(arms, "treatment_1", covariates or []), row_id, "treatment_1", "logit")
        kept = df.join(m.select(F.explode(F.array("treated", "control")).alias(row_id)), row_id, "left_semi")
    else:
        kept = df
    counts = df.agg(F.count(F.lit(1)).alias("before")).withColumn("after", kept.agg(F.count(F.lit(1)).alias("n")).scalar())
    return kept, counts

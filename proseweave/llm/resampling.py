"""Importance resampling towards a target text set, by hashed word-run features with a head-tail vocabulary.

A feature is a run of one to ``longest`` consecutive words; its bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.
The head of the vocabulary is broadcast: the exact CRC states of frequent words, from which the CRC of any run that begins
with one goes on, and the buckets of frequent pairs. A feature outside the head takes its CRC directly, and nothing about it
is kept, so a task's memory is bounded whatever the tail is. The head only saves work: bucket totals, gains and scores are
exact with any head, the empty one included. It is a Misra-Gries summary of all documents, ``HEAD`` entries at most.

Bucket totals of the corpus and of the target are sums over all rows, ``buckets`` rows in the end. The gain of a bucket is
the floored log ratio of the two smoothed shares in thousandths, a document's weight the floored mean of its features'
gains, its score the weight plus Gumbel noise from a hash of its id, so the highest scores are a sample without
replacement in proportion to the weights.

Ranks come from counted values: the cut is read from counts by score, only rows at or above it are sorted, in ranges, and
equal rows are counted before; no task sees a whole group.

Defined cases: a null text has no words; a null id counts as the empty string in the hash and ranks after all ids of its
score; repeated rows have one score and ranks of their own; an empty corpus gives no rows, an empty target smoothed shares
only; texts of any length are read whole, other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.heavy import Summary
from ..operators.ordered import in_ranges, rank_table
from ..session import cut_lineage
from .batches import per_text

LONGEST, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Entries of the head, and the bytes that one of them may have (a longer word is left to the tail).
HEAD, HEAD_BYTES = 20_000, 64

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; no ASCII sign but letters and digits belongs to one."""
    return _WORD.findall(text.lower())


class Buckets(dict):
    """Bucket of a feature. The head is held; any other feature is computed each time and not kept."""

    def __init__(self, states: dict[bytes, int], pairs: dict[bytes, int], buckets: int):
        super().__init__({word: state % buckets for word, state in states.items()} | pairs)
        self.states, self.buckets = states, buckets

    def __missing__(self, feature: bytes) -> int:
        first, blank, rest = feature.partition(b" ")
        state = self.states.get(first) if blank else None
        return (zlib.crc32(feature) if state is None else zlib.crc32(blank + rest, state)) % self.buckets

    def __reduce__(self):
        return Buckets, (self.states, {f: b for f, b in self.items() if b" " in f}, self.buckets)

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        """Buckets of all runs of one to ``longest`` words."""
        parts = [np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        for size in range(2, longest + 1):
            runs = map(b" ".join, zip(*[words[k:] for k in range(size)], strict=False))
            parts.append(np.fromiter(map(self.__getitem__, runs), np.int64, max(0, len(words) - size + 1)))
        return np.concatenate(parts)


def head_of(documents: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, entries: int = HEAD) -> Buckets:
    """The head: frequent words with their CRC states and, for runs of several words, frequent pairs with their buckets.
    Each holds one in ``entries`` of all counts or more, so there are at most ``entries`` of both together, wherever they
    are sorted out, and the table is bounded by ``entries * HEAD_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Summary(entries)
        for batch in batches:
            for value in batch.column(0).cast(pa.large_binary()).to_pylist():
                words = words_of(value or b"")
                # a long text is counted in bounded steps
                for at in range(0, len(words), 1 << 16):
                    part = words[at : at + (1 << 16)]
                    seen.add(part)
                    if longest > 1:
                        seen.add(map(b" ".join, zip(part, part[1:], strict=False)))
        seen.reduce()
        short = [(f, n) for f, n in seen.counts.items() if len(f) <= HEAD_BYTES]
        if short:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in short], pa.binary()), pa.array([n for _, n in short], pa.int64())], names=["feature", "n"])

    counted = cut_lineage(documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") * entries >= total).select("feature").collect()
    features = sorted(bytes(r.feature) for r in rows)
    states = {f: zlib.crc32(f) for f in features if b" " not in f}
    return Buckets(states, {f: zlib.crc32(f) % buckets for f in features if b" " in f}, buckets)


def bucket_totals(texts: DataFrame, head: Buckets, text: str = "text", longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket, exact. A task hands on its own sums, which are added by bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = sent.value, np.zeros(sent.value.buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.large_binary()).to_pylist():
                if value:
                    sums += np.bincount(table.of(words_of(value), longest), minlength=len(sums))
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], names=["bucket", "n"])

    own = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(head.buckets, np.int64)
    for r in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of target to corpus share, smoothed by one in each bucket."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (all_corpus + n)) / ((corpus + 1.0) * (all_target + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


@dataclass
class Model:
    head: Buckets
    gains: np.ndarray
    longest: int


def train(documents: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, entries: int = HEAD) -> Model:
    head = head_of(documents, text, longest, buckets, entries)
    return Model(head, gains_of(bucket_totals(documents, head, text, longest), bucket_totals(target, head, text, longest)), longest)


def weigh(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_words``, ``n_features`` and ``weight`` of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> list[pa.Array]:
        m, out = sent.value, []
        for value in column.cast(pa.large_binary()).to_pylist():
            words = words_of(value or b"")
            found = m.head.of(words, m.longest) if words else np.zeros(0, np.int64)
            out.append((len(words), len(found), int(m.gains[found].sum()) // len(found) if len(found) else 0))
        return [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]

    return per_text(documents, key, text, work, "n_words bigint, n_features bigint, weight bigint")


def noise(key: str, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel variate from the hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Key, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document; the rank, from 1, is that of
    the drawn ones: ``percent`` of the documents with ``least_words`` words or more, by score, then key."""
    columns = [key, "n_words", "n_features", "weight", "score"]
    scored = weigh(documents, model, key, text).withColumn("score", F.col("weight") + noise(key, seed)).select(columns)
    scored = cut_lineage(scored)
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    # scores are whole numbers; the last one that is drawn from is found among their counts
    low = scored.where(enough).select(F.lit("score").alias("feature"), (-F.col("score")).alias("value"))
    cut = rank_table(low).where(F.col("before") < drawn).agg(F.max("value").alias("v")).scalar() if drawn else F.lit(None)
    cut = scored.sparkSession.range(1).select(cut.alias("v")).first()["v"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*columns, none)
    top = enough & (F.col("score") >= -int(cut))
    counted = scored.where(top).groupBy(columns).agg(F.count(F.lit(1)).alias("_n"))
    order = ["_low", "_none", key, "n_features", "weight", "n_words"]
    dealt = in_ranges(counted.withColumn("_low", -F.col("score")).withColumn("_none", F.col(key).isNull()), *order)
    sums = dealt.groupBy("_part").agg(F.sum("_n").alias("_s"))
    # one row for each range
    before = sums.select("_part", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = dealt.withColumn("_in", inside).join(before, "_part").withColumn("_first", F.col("_before") + F.col("_in") + 1)
    ranked = first.select(*columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~top).select(*columns, none))

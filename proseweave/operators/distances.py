"""Sentence distances inside a story.

Long form in, long form out: rows ``(story_id, pos, payload)`` with ``pos`` unique per story. The
payload is ``vec`` (array<double>) for cosine, ``tokens`` (array<string>) for Jaccard, and
``words`` (array<struct<n, vec>>) for word-mover distances.

Consecutive distances join each row to its successor in blocks (no task holds a whole story).
All-pairs summaries cut a story into blocks of ``block`` sentences and work on tiles of two blocks;
a tile leaves only counts, sums, extremes and histogram cells behind, never its pairs. Means and
deviations of cosine distances also have a linear form (``pair_moments``), which needs no tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import vectors as V
from ..session import cut_lineage, store
from .encode import Words, by_blocks
from .ordered import exact_quantiles, next_row

KEY, POS = "story_id", "pos"
PAYLOAD = {"cosine": "vec", "jaccard": "tokens", "wmd": "words", "wmd_relaxed": "words"}
METRICS = tuple(PAYLOAD)
#: Sentences of a block; a cosine is cheap, so its blocks are wider and fewer of them meet.
BLOCK, WIDE_BLOCK = 64, 256
#: Cells of a histogram, and of one over so few distances that their own number bounds its cells.
BINS, FEW, FINE = 2048, 1 << 16, 1 << 40
#: Cells of a tile that are handed on together.
CELL_ROWS = 1 << 16


def _check(metric: str) -> None:
    if metric not in PAYLOAD:
        raise ValueError(f"unknown distance {metric!r}; choose from {METRICS}")


# --- one payload against another -----------------------------------------------------------
#
# A block of sentences travels to Python as three flat arrays: values, weights, and how many values
# rows belong to each sentence. Flat arrays cross Arrow without per-row objects.


def _packed(metric: str, items: Column) -> list[Column]:
    """Columns (values, weights, sizes) of an array of payloads."""
    none = F.array().cast("array<double>")
    if metric == "cosine":
        return [F.flatten(items), none, F.transform(items, lambda x: F.lit(1))]
    sizes = F.transform(items, lambda x: F.size(x))
    if metric == "jaccard":
        return [F.flatten(items), none, sizes]
    words = F.flatten(items)
    return [F.flatten(words["vec"]), F.transform(words, lambda w: w["n"].cast("double")), sizes]


def _unpack(metric: str, values, weights, sizes):
    stops = np.cumsum(np.asarray(sizes, dtype=np.int64))
    if metric == "jaccard":
        return [list(values[e - k : e]) for e, k in zip(stops, sizes)]
    rows = int(stops[-1]) if len(stops) else 0
    m = np.asarray(values, dtype=float).reshape(rows, -1) if rows else np.zeros((0, 0))
    if metric == "cosine":
        return m
    w = np.asarray(weights, dtype=float)
    return [(m[e - k : e], w[e - k : e]) for e, k in zip(stops, sizes)]


def _mover(a, b, exact: bool) -> float:
    """Half the word-mover distance of two (vectors, counts); NaN when a side has no known word."""
    (va, wa), (vb, wb) = a, b
    if len(wa) == 0 or len(wb) == 0:
        return float("nan")
    costs = K.word_costs(va, vb)
    if exact:
        return max(0.0, K.exact_transport(costs, wa, wb) / 2)
    return max(0.0, K.relaxed_transport(costs, wa / wa.sum(), wb / wb.sum()) / 2)


def _tile_values(metric: str, left, right, same: bool) -> np.ndarray:
    """Distances of one tile as a flat array: i < j inside a block, all pairs across blocks."""
    return _values(metric, _unpack(metric, *left), _unpack(metric, *right), same)


def _values(metric: str, a, b, same: bool) -> np.ndarray:
    if metric == "cosine":
        d = K.cosine_tile(a, b)
    elif metric == "jaccard":
        d = K.jaccard_tile(a, b)
    else:
        d = np.full((len(a), len(b)), np.nan)
        for i, x in enumerate(a):
            for j in range(i + 1 if same else 0, len(b)):
                d[i, j] = _mover(x, b[j], metric == "wmd")
    return d[np.triu_indices(len(a), k=1)] if same else d.ravel()


def pair_distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of two payload columns of the same row (Jaccard gives a similarity), null when
    undefined."""
    _check(metric)
    if metric == "cosine":
        return V.cosine_distance(a, b)

    @F.pandas_udf("double")
    def run(x: pd.Series, xw: pd.Series, xs: pd.Series, y: pd.Series, yw: pd.Series, ys: pd.Series) -> pd.Series:
        out = [_tile_values(metric, (p, pw, ps), (q, qw, qs), False)[0] for p, pw, ps, q, qw, qs in zip(x, xw, xs, y, yw, ys)]
        return pd.Series(out, dtype=float)

    value = run(*_packed(metric, F.array(a)), *_packed(metric, F.array(b)))
    return F.nanvl(value, F.lit(None).cast("double"))


# --- consecutive ---------------------------------------------------------------------------


def consecutive(long: DataFrame, metric: str = "cosine", key: str = KEY, pos: str = POS) -> DataFrame:
    """(key, step, d): distance of every sentence to the next one. ``step`` is the 0-based position
    of the earlier sentence. Undefined distances (a zero vector, no known word) are null."""
    _check(metric)
    p = PAYLOAD[metric]
    pairs = next_row(long.select(key, pos, p), key, pos, {p: "_next"}).where(F.col("_next").isNotNull())
    return pairs.select(key, F.col(pos).alias("step"), pair_distance(metric, F.col(p), F.col("_next")).alias("d"))


def _known_words(bags: pa.Array, vocabulary: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each bag of tokens the rows of the vocabulary's matrix that are its words' vectors, and their counts."""
    if not len(bags):
        return []
    items = bags.flatten()
    place, row = vocabulary.places(items.field("token"))
    counts = items.field("n").to_numpy(zero_copy_only=False).astype(float)[place]
    stops = np.searchsorted(place, np.cumsum(pc.list_value_length(bags).to_numpy(zero_copy_only=False)))
    return list(zip(np.split(row, stops[:-1]), np.split(counts, stops[:-1]), strict=True))


def consecutive_words(bags: DataFrame, vocabulary: DataFrame, metric: str = "wmd", key: str = KEY, pos: str = POS) -> DataFrame:
    """As ``consecutive`` for a word-mover metric, from bags without vectors (``encode.token_bags``) and the vocabulary: words
    of neighbours meet first, and the vectors come to blocks of such pairs, each once for a block."""
    if metric not in ("wmd", "wmd_relaxed"):
        raise ValueError("metric must be wmd or wmd_relaxed")
    near = next_row(bags.select(key, pos, "words"), key, pos, {"words": "_next"}).where(F.col("_next").isNotNull())
    pairs = cut_lineage(near.select(key, F.col(pos).alias("step"), F.col("words").alias("a"), F.col("_next").alias("b")))

    def work(table: pa.Table, vocabulary: Words) -> pa.Table:
        a, b = (_known_words(table.column(c).combine_chunks(), vocabulary) for c in "ab")
        held = lambda bag: (vocabulary.matrix[bag[0]], bag[1])
        d = np.array([_mover(held(x), held(y), metric == "wmd") for x, y in zip(a, b, strict=True)], float)
        return table.drop_columns(["a", "b"]).append_column("d", pa.array(d, from_pandas=True))

    schema = T.StructType([f for f in pairs.schema.fields if f.name not in ("a", "b")] + [T.StructField("d", T.DoubleType())])
    return by_blocks(pairs, F.array_union("a.token", "b.token"), vocabulary, work, schema, (key, "step"))


def consecutive_jaccard(tokens: DataFrame, key: str = KEY, pos: str = POS) -> DataFrame:
    """Consecutive multiset Jaccard without Python: token counts of neighbours meet in an equi-join
    on (story, position, token). Needs dense positions. shared = sum of smaller counts."""
    sized = tokens.select(key, pos, F.size("tokens").alias("m"), "tokens")
    counts = sized.select(key, pos, F.explode("tokens").alias("t")).groupBy(key, pos, "t").agg(
        F.count(F.lit(1)).alias("n")
    )
    after = counts.select(key, (F.col(pos) - 1).alias(pos), "t", F.col("n").alias("n2"))
    shared = counts.join(after, [key, pos, "t"]).groupBy(key, pos).agg(F.sum(F.least("n", "n2")).alias("shared"))
    sizes = sized.select(key, pos, "m")
    nxt = sizes.select(key, (F.col(pos) - 1).alias(pos), F.col("m").alias("m2"))
    s = F.coalesce(F.col("shared"), F.lit(0))
    union = F.col("m") + F.col("m2") - s
    return (
        sizes.join(nxt, [key, pos])
        .join(shared, [key, pos], "left")
        .select(key, F.col(pos).alias("step"), F.when(union == 0, 1.0).otherwise(s / union).alias("d"))
    )


def summarise_steps(steps: DataFrame, key: str = KEY) -> DataFrame:
    """mean, median, population std, min, max of ``d`` per story; null when a distance is undefined."""
    steps = cut_lineage(steps)  # a distance may be dear: the moments and the median read it back
    base = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("d").alias("_known"),
        F.avg("d").alias("mean"),
        F.stddev_pop("d").alias("std"),
        F.min("d").alias("min"),
        F.max("d").alias("max"),
    )
    med = exact_quantiles(steps.withColumnRenamed("d", "value"), {"median": 0.5}, group=key)
    ok = F.col("_rows") == F.col("_known")
    return base.join(med, key, "left").select(
        key, *[F.when(ok, F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")]
    )


# --- all pairs: linear moments -------------------------------------------------------------


def pair_moments(vectors: DataFrame, key: str = KEY) -> DataFrame:
    """Mean of all pairwise cosine distances from the sum of unit vectors, one pass, map-side
    combined: mean similarity = (|sum u|^2 - n) / (n (n - 1))."""
    u = V.unit(F.col("vec"))
    agg = vectors.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(u.isNull().cast("int")).alias("_zero"),
        Summarizer.mean(array_to_vector(F.coalesce(u, F.transform("vec", lambda x: F.lit(0.0))))).alias("_m"),
    )
    m = vector_to_array(F.col("_m"))
    n = F.col("n")
    sims = (V.dot(m, m) * n * n - n) / (n * (n - 1))
    return agg.select(
        key, "n", F.when(n == 1, 1.0).when(F.col("_zero") == 0, 1.0 - sims).alias("mean")
    )


# --- all pairs: tiles ----------------------------------------------------------------------


def _blocks(long: DataFrame, payload: str, key: str, pos: str, block: int) -> DataFrame:
    """(key, b, items): the payloads of ``block`` positions, in their order."""
    rows = long.select(key, F.floor(F.col(pos) / block).alias("b"), F.struct(pos, payload).alias("it"))
    return rows.groupBy(key, "b").agg(F.array_sort(F.collect_list("it")).alias("items")).select(key, "b", F.col(f"items.{payload}").alias("items"))


def _spans(long: DataFrame, key: str, pos: str, block: int) -> DataFrame:
    """(key, last): the last block of the stories of several blocks. Positions start at 0, so these have a block above 0."""
    return long.where(F.col(pos) >= block).groupBy(key).agg(F.floor(F.max(pos) / block).alias("last"))


def _met(blocks: DataFrame, spans: DataFrame, key: str, *carry: str) -> DataFrame:
    """(key, i, j, same, left, right): all tiles of the stories of ``spans``, and its columns ``carry``. The left block is
    sent to each of its tiles, the right one meets it there."""
    first = blocks.join(spans, key).select(key, *carry, F.col("b").alias("i"), F.col("items").alias("left"), F.explode(F.sequence("b", "last")).alias("j"))
    second = blocks.select(key, F.col("b").alias("j"), F.col("items").alias("right"))
    return first.join(second, [key, "j"]).select(key, *carry, "i", "j", (F.col("i") == F.col("j")).alias("same"), "left", "right")


def tiles(long: DataFrame, payload: str, key: str = KEY, pos: str = POS, block: int = BLOCK) -> DataFrame:
    """(key, i, j, same, left, right, lone): payload arrays of two blocks of one story.

    ``lone`` marks stories of a single block, which need no second shuffle. A longer story sends
    each block to the tiles it takes part in, keyed by (story, j), so even one giant story is
    spread.
    """
    blocks, spans = _blocks(long, payload, key, pos, block), _spans(long, key, pos, block)
    return _lone(blocks.join(spans, key, "left_anti"), key).unionByName(_met(blocks, spans, key).withColumn("lone", F.lit(False)))


def _lone(blocks: DataFrame, key: str) -> DataFrame:
    """The tiles of stories of a single block."""
    nought = F.lit(0).cast("bigint")
    return blocks.select(key, nought.alias("i"), nought.alias("j"), F.lit(True).alias("same"), F.col("items").alias("left"), F.col("items").alias("right"), F.lit(True).alias("lone"))


def _stats_of(d: np.ndarray) -> tuple:
    bad = int(np.isnan(d).sum())
    good = d[~np.isnan(d)] if bad else d
    if good.size:
        return d.size, bad, good.sum(), good @ good, good.min(), good.max(), np.median(good)
    return d.size, bad, 0.0, 0.0, np.nan, np.nan, np.nan


_STATS = "n long, nan long, s double, ss double, lo double, hi double, med double"
_STAT_NAMES = [part.split()[0] for part in _STATS.split(", ")]


def _tile_stats(metric: str, left: Column, right: Column, same: Column) -> Column:
    @F.pandas_udf(_STATS)
    def run(x: pd.Series, xw: pd.Series, xs: pd.Series, y: pd.Series, yw: pd.Series, ys: pd.Series, one: pd.Series) -> pd.DataFrame:
        rows = [_stats_of(_tile_values(metric, (p, pw, ps), (q, qw, qs), bool(o))) for p, pw, ps, q, qw, qs, o in zip(x, xw, xs, y, yw, ys, one)]
        return pd.DataFrame(rows, columns=_STAT_NAMES)

    return run(*_packed(metric, left), *_packed(metric, right), same)


def _word_tiles(metric: str, table: pa.Table, vocabulary: Words) -> Iterator[np.ndarray]:
    """Distances of each tile of bags without vectors; a tile of one block has no right side of its own."""
    sides = []
    for name in ("left", "right"):
        column = table.column(name).combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        sides.append((_known_words(column.flatten(), vocabulary), np.concatenate([[0], np.cumsum(sizes)])))
    for k, same in enumerate(table.column("same").to_pylist()):
        a, b = ([(vocabulary.matrix[row], n) for row, n in bags[ends[k] : ends[k + 1]]] for bags, ends in sides)
        yield _values(metric, a, a if same else b, same)


def _by_words(t: DataFrame, key: str, vocabulary: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``work`` on blocks of tiles, each with the vectors of its own words (``encode.by_blocks``)."""
    t = store(t.withColumn("right", F.when(~F.col("same"), F.col("right"))))
    bags = F.concat("left", F.coalesce("right", F.slice("left", 1, 0)))
    return by_blocks(t, F.array_distinct(F.flatten(bags)["token"]), vocabulary, work, schema, (key, "i", "j"))


def _stats(t: DataFrame, metric: str, key: str, vocabulary: DataFrame | None) -> DataFrame:
    """(key, lone, rows, n, nan, s, ss, lo, hi, med) of every tile."""
    t = t.withColumn("rows", F.size("left"))
    if vocabulary is None:
        return t.select(key, "lone", "rows", _tile_stats(metric, F.col("left"), F.col("right"), F.col("same")).alias("t")).select(key, "lone", "rows", "t.*")
    kept = [key, "lone", "rows"]

    def work(table: pa.Table, words: Words) -> pa.Table:
        columns = zip(*[_stats_of(d) for d in _word_tiles(metric, table, words)], strict=True) if len(table) else [[]] * len(_STAT_NAMES)
        made = [pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)]
        return pa.table([*(table.column(c) for c in kept), *made], names=[*kept, *_STAT_NAMES])

    schema = T.StructType([*(t.schema[c] for c in kept), *T.StructType.fromDDL(_STATS).fields])
    return _by_words(t, key, vocabulary, work, schema)


def _cells_of(d: np.ndarray, lo: float, width: float, bins: int) -> tuple[np.ndarray, ...]:
    """Cells of the distances inside [lo, lo + width): index, count and extremes of each that is not empty."""
    d = np.sort(d[(d >= lo) & (d < lo + width)])
    cell = np.minimum(((d - lo) / width * bins).astype(np.int64), bins - 1)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(d) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(d)))
    return cell[first], n, d[first], d[first + n - 1]


_CELLS = "at int, cell long, n long, low double, high double"
_CELL_TYPES = {"at": pa.int32(), "cell": pa.int64(), "n": pa.int64(), "low": pa.float64(), "high": pa.float64()}


def _cell_batches(keys: pa.Array, wants: list, distances: Iterator[np.ndarray], key: str) -> Iterator[pa.RecordBatch]:
    """(key, at, cell, n, low, high) of tiles with their keys and brackets. They leave as flat columns, some tiles at a time,
    so a task never holds the cells of all its tiles."""
    held, size = [], 0
    for k, (want, d) in enumerate(zip(wants, distances, strict=True)):
        for at, w in enumerate(want):
            found = _cells_of(d, w["lo"], w["width"], w["bins"])
            held.append((k, at, found))
            size += len(found[0])
        if held and (size >= CELL_ROWS or k == len(keys) - 1):
            places, ats, made = zip(*held, strict=True)
            times = [len(f[0]) for f in made]
            columns = [keys.take(pa.array(np.repeat(places, times))), np.repeat(ats, times), *(np.concatenate(c) for c in zip(*made, strict=True))]
            yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(c, kind) for c, kind in zip(columns[1:], _CELL_TYPES.values(), strict=True))], names=[key, *_CELL_TYPES])
            held, size = [], 0


def _cells(t: DataFrame, metric: str, key: str, vocabulary: DataFrame | None) -> DataFrame:
    """(key, at, cell, n, low, high): the cells of every tile for each bracket of its ``want``."""
    schema = T.StructType([t.schema[key], *T.StructType.fromDDL(_CELLS).fields])
    if vocabulary is not None:

        def work(table: pa.Table, words: Words) -> pa.Table:
            keys = table.column(key).combine_chunks()
            made = _cell_batches(keys, table.column("want").to_pylist(), _word_tiles(metric, table, words), key)
            return pa.Table.from_batches(made, pa.schema([(key, keys.type), *_CELL_TYPES.items()]))

        return _by_words(t, key, vocabulary, work, schema)

    def payload(value: pa.Scalar):
        if not value.is_valid:
            return None
        return value.as_py() if pa.types.is_string(value.type.value_type) else value.values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*batch.columns[3:], batch.column(2).to_pylist(), strict=True)
            distances = (_tile_values(metric, *(tuple(map(payload, part[k : k + 3])) for k in (0, 3)), same) for *part, same in sides)
            yield from _cell_batches(batch.column(0), batch.column(1).to_pylist(), distances, key)

    packed = [c.alias(f"_{k}") for k, c in enumerate([*_packed(metric, F.col("left")), *_packed(metric, F.col("right"))])]
    return t.select(key, "want", "same", *packed).mapInArrow(run, schema)


def _order_statistic(blocks: DataFrame, spans: DataFrame, targets: DataFrame, metric: str, key: str, vocabulary: DataFrame | None = None, tol: float = 1e-12) -> DataFrame:
    """(key, k, value): exact k-th smallest distances of long stories: narrow a histogram until the cell that holds one
    contains one value (up to ``tol``, far below the rounding of the distances themselves). ``targets`` has the extremes of a
    story and its ``ks``. Few distances are told apart by as many cells as needed, so two rounds mostly do."""
    bracket = lambda lo, width, below, n, ks: F.struct(lo.alias("lo"), width.alias("width"), below.alias("below"), F.when(n <= FEW, FINE).otherwise(BINS).cast("long").alias("bins"), ks.alias("ks"))
    whole = bracket(F.col("min") - 1e-9, F.col("max") - F.col("min") + 2e-9, F.lit(0).cast("long"), F.lit(FEW + 1), F.col("ks"))
    want, found = cut_lineage(targets.select(key, F.array(whole).alias("want"))), None
    for _ in range(4):
        t = _met(blocks, spans.join(want, key), key, "want")
        cells = _cells(t, metric, key, vocabulary).groupBy(key, "at", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        # at most FEW rows of a bracket: a bounded window
        w = W.partitionBy(key, "at").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        met = cells.join(want, key).withColumn("in", F.get("want", F.col("at"))).withColumn("acc", F.col("before") + F.col("in.below"))
        ks = F.filter("in.ks", lambda k: (F.col("acc") <= k) & (k < F.col("acc") + F.col("n")))
        hit = cut_lineage(met.select(key, "acc", "n", "low", "high", ks.alias("ks")).where(F.size("ks") > 0))
        width = F.col("high") - F.col("low")
        done = hit.where(width <= tol).select(key, F.explode("ks").alias("k"), F.col("low").alias("value"))
        found = done if found is None else found.unionByName(done)
        rest = hit.where(width > tol)
        if rest.isEmpty():
            return found
        narrow = bracket(F.col("low"), width * (1 + 1e-9), F.col("acc"), F.col("n"), F.col("ks"))
        want = cut_lineage(rest.groupBy(key).agg(F.array_sort(F.collect_list(narrow)).alias("want")))
    return found.unionByName(rest.select(key, F.explode("ks").alias("k"), F.col("low").alias("value")))


def pair_summary(long: DataFrame, metric: str = "cosine", key: str = KEY, pos: str = POS, block: int | None = None,
                 max_rows: int | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """mean, median, population std, min, max over all sentence pairs of a story, with ``n_pairs``.

    A one-sentence story counts as the single value 1. ``max_rows`` states that longer stories are
    not wanted (the analysis window); since positions are dense, rows past it are dropped before any
    shuffle and a story never brings more than ``max_rows + 1`` rows. For a word-mover metric with a ``vocabulary``, ``words``
    are bags without vectors (``encode.token_bags``); a word's vector comes once to a block of tiles.
    """
    _check(metric)
    if vocabulary is not None and metric not in ("wmd", "wmd_relaxed"):
        raise ValueError("only a word-mover metric takes a vocabulary")
    block = block or (WIDE_BLOCK if metric == "cosine" else BLOCK)
    p = PAYLOAD[metric]
    rows = long.select(key, pos, p)
    if max_rows is not None:
        block = max(block, max_rows + 1)
        rows = rows.where(F.col(pos) <= max_rows)
    blocks = _blocks(rows, p, key, pos, block)
    several = max_rows is None and not rows.where(F.col(pos) >= block).isEmpty()
    if several:
        spans = cut_lineage(_spans(rows, key, pos, block))
        # the moments read these blocks, and each round of the median
        long_blocks = store(blocks.join(spans.select(key), key, "left_semi"))
        t = _lone(blocks.join(spans, key, "left_anti"), key).unionByName(_met(long_blocks, spans, key).withColumn("lone", F.lit(False)))
    else:
        t = _lone(blocks, key)
    if max_rows is not None:
        t = t.where(F.size("left") <= max_rows)
    parts = _stats(t, metric, key, vocabulary)
    single = F.max(F.col("lone") & (F.col("rows") == 1))
    stats = parts.groupBy(key).agg(
        single.alias("single"),
        F.max("lone").alias("lone"),
        F.sum("n").alias("n_pairs"),
        F.sum("nan").alias("bad"),
        F.sum("s").alias("s"),
        F.sum("ss").alias("ss"),
        F.min(F.nanvl("lo", F.lit(None).cast("double"))).alias("min"),
        F.max(F.nanvl("hi", F.lit(None).cast("double"))).alias("max"),
        F.max(F.nanvl("med", F.lit(None).cast("double"))).alias("med"),
    )
    n = F.col("n_pairs")
    mean = F.col("s") / n
    std = F.sqrt(F.greatest(F.col("ss") / n - mean * mean, F.lit(0.0)))
    if several:
        stats = cut_lineage(stats)
        ks = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
        want = stats.where(~F.col("lone") & (F.col("bad") == 0)).select(key, "min", "max", ks.alias("ks"))
        med = _order_statistic(long_blocks, spans, want, metric, key, vocabulary).groupBy(key).agg(F.avg("value").alias("long_med"))
        stats = stats.join(med, key, "left").withColumn("med", F.coalesce("long_med", "med"))
    one = F.col("single")
    ok = F.col("bad") == 0
    pick = lambda c, lone: F.when(one, F.lit(lone)).when(ok, c)
    return stats.select(
        key,
        F.when(one, 1).otherwise(n).cast("bigint").alias("n_pairs"),
        pick(mean, 1.0).alias("mean"),
        pick(F.col("med"), 1.0).alias("median"),
        pick(std, 0.0).alias("std"),
        pick(F.col("min"), 1.0).alias("min"),
        pick(F.col("max"), 1.0).alias("max"),
    )


def paraphrase_vs_rest(long: DataFrame, index: DataFrame, metric: str = "cosine", key: str = KEY, pos: str = POS,
                       compat: bool = False, text: str | None = None) -> DataFrame:
    """d(source, paraphrase) - mean d(other pairs); 0 for stories without a usable pair.

    ``index`` holds (key, src, dst), one row per story. Cosine: the others are all sentences that are
    not the paraphrase (by ``text`` when given, else by position). Jaccard and word-mover: the others
    are the pairs touching neither member. ``compat`` measures sentences 0 and 1 instead of the pair
    for the last two.
    """
    _check(metric)
    p = PAYLOAD[metric]
    marked = long.join(index.select(key, "src", "dst"), key)
    a_pos, b_pos = (F.lit(0), F.lit(1)) if compat and metric != "cosine" else (F.col("src"), F.col("dst"))
    ends = marked.where((F.col(pos) == a_pos) | (F.col(pos) == b_pos))
    pair = ends.groupBy(key).agg(
        F.first(F.when(F.col(pos) == a_pos, F.col(p)), True).alias("a"),
        F.first(F.when(F.col(pos) == b_pos, F.col(p)), True).alias("b"),
        *([F.first(F.when(F.col(pos) == F.col("dst"), F.col(text)), True).alias("_ptext")] if text and metric == "cosine" else []),
    )
    if metric == "cosine" and text:
        others = marked.join(pair.select(key, "_ptext"), key).where(F.col(text) != F.col("_ptext"))
    elif metric == "cosine":
        others = marked.where(F.col(pos) != F.col("dst"))
    else:
        others = marked.where((F.col(pos) != F.col("src")) & (F.col(pos) != F.col("dst")))
    if metric == "cosine":
        rest = pair_moments(others, key).where("n > 1").select(key, F.col("mean").alias("rest"))
    else:
        rest = pair_summary(others, metric, key, pos).join(
            others.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), key, "left_semi"
        ).select(key, F.col("mean").alias("rest"))
    d = pair.where("a is not null and b is not null").select(key, pair_distance(metric, F.col("a"), F.col("b")).alias("d"))
    # a missing member is an error in the source data and gives 0; an undefined mean gives null
    return (
        index.select(key)
        .join(d.withColumn("_has", F.lit(True)), key, "left")
        .join(rest, key, "left")
        .select(key, F.when(F.col("_has"), F.col("d") - F.col("rest")).otherwise(F.lit(0.0)).alias("para_vs_others"))
    )


# --- wide form -----------------------------------------------------------------------------

STATS = ("mean", "median", "std", "min", "max")


def wide_name(model: str, scope: str, metric: str, stat: str) -> str:
    return f"{model}_{scope}_{metric}_sentences_similarity_{stat}"


def feature_table(encoded: dict[str, DataFrame], metrics: dict[str, list[str]] | None = None, key: str = KEY,
                  pos: str = POS, index: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """All distance features, one row per story.

    ``encoded`` maps a model name to its long table; ``metrics`` says which distances a model has
    (default: cosine). With ``index`` the paraphrase feature is added. Summaries of all models are
    stacked as long rows and pivoted once.
    """
    stacked, extra = None, []
    names: list[str] = []
    for model, long in encoded.items():
        for metric in (metrics or {}).get(model, ["cosine"]):
            rows = long if max_rows is None else within(long, max_rows, key, pos)
            for scope, table in (
                ("consecutive", _with_single(summarise_steps(consecutive(rows, metric, key, pos), key), rows, key)),
                ("all", pair_summary(rows, metric, key, pos, max_rows=max_rows)),
            ):
                part = table.select(key, *[F.col(s).alias(wide_name(model, scope, metric, s)) for s in STATS])
                names += [wide_name(model, scope, metric, s) for s in STATS]
                part = part.unpivot([key], part.columns[1:], "name", "v")
                stacked = part if stacked is None else stacked.unionByName(part)
            if index is not None:
                name = f"{model}_para_vs_others_{metric}_sentences_similarity"
                extra.append(
                    paraphrase_vs_rest(rows, index, metric, key, pos).select(
                        key, F.lit(name).alias("name"), F.col("para_vs_others").alias("v")
                    )
                )
                names.append(name)
    for part in extra:
        stacked = stacked.unionByName(part)
    return stacked.groupBy(key).pivot("name", names).agg(F.first("v"))


def _with_single(summary: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Stories of one sentence have the constant 1 (deviation 0)."""
    ones = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(
        key, *[F.lit(0.0 if s == "std" else 1.0).alias(s) for s in STATS]
    )
    return summary.unionByName(ones.select(summary.columns))


def within(long: DataFrame, max_rows: int, key: str = KEY, pos: str = POS) -> DataFrame:
    """Rows of stories with at most ``max_rows`` sentences. Dense positions: only rows up to
    ``max_rows`` are shuffled, so a longer story costs at most ``max_rows + 1`` rows."""
    head = long.where(F.col(pos) <= max_rows)
    names = [c for c in long.columns if c != key]
    return (
        head.groupBy(key)
        .agg(F.collect_list(F.struct(*names)).alias("_it"))
        .where(F.size("_it") <= max_rows)
        .select(key, F.inline("_it"))
    )

"""Semantic-density scores: one value per story from its sentence vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solvers as S
from ..functions.text import once
from .distances import BLOCK, consecutive, tiles
from .ordered import running_sum

KEY, POS = "story_id", "pos"
MAX_SENTENCES = 19  # the analysis keeps stories of fewer than 20 sentences


# --- movement ------------------------------------------------------------------------------


def narrative_speed(vectors: DataFrame, doubled: bool = True, guard: bool = True, key: str = KEY, pos: str = POS) -> DataFrame:
    """(key, n, speed, speed_norm). With steps d_0..d_{m-1} the summed gradient of the cumulative
    distance is d_1 + ... + d_{m-1} + (d_1 + d_{m-1}) / 2: plain aggregates, so no task ever holds
    a story. ``guard`` gives 0 for two steps or fewer."""
    agg = (
        consecutive(vectors, "cosine", key, pos)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("m"),
            F.sum(F.when(F.col("step") > 0, F.col("d"))).alias("s"),
            F.max(F.when(F.col("step") == 1, F.col("d"))).alias("d1"),
            F.max_by("d", "step").alias("dl"),
            F.count(F.when((F.col("step") > 0) & F.col("d").isNull(), 1)).alias("bad"),
        )
        .withColumn("n", F.col("m") + 1)
    )
    total = (F.col("s") + (F.col("d1") + F.col("dl")) / 2) / F.col("m") * (2.0 if doubled else 1.0)
    value = F.when(F.col("bad") == 0, total)
    if guard:
        value = F.when(F.col("m") <= 2, 0.0).otherwise(value)
    sizes = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lone = sizes.where("n = 1").select(key, "n", F.lit(0.0 if guard else None).cast("double").alias("speed"))
    out = agg.select(key, "n", value.alias("speed")).unionByName(lone)
    return out.withColumn("speed_norm", F.col("speed") / F.col("n"))


def trajectory(vectors: DataFrame, key: str = KEY, pos: str = POS) -> DataFrame:
    """(key, step, d, path): cumulative consecutive distance along the story."""
    return running_sum(consecutive(vectors, "cosine", key, pos), key, "step", "d", "path")


def trajectory_score(vectors: DataFrame, key: str = KEY, pos: str = POS) -> DataFrame:
    """Path length over the number of sentences."""
    n = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    length = consecutive(vectors, "cosine", key, pos).groupBy(key).agg(F.sum("d").alias("length"))
    return n.join(length, key, "left").select(
        key, (F.coalesce(F.col("length"), F.lit(0.0)) / F.col("n")).alias("trajectory_score")
    )


# --- clusters ------------------------------------------------------------------------------


def _label_sums(left: list[Column], right: list[Column], same: Column) -> Column:
    """Per sentence of a tile, given as (flat vectors, positions, labels) of both sides: summed distance
    to each label on the other side."""

    @F.pandas_udf("array<struct<pos long, own int, other int, s double, n long>>")
    def run(v: pd.Series, p: pd.Series, l: pd.Series, v2: pd.Series, p2: pd.Series, l2: pd.Series, one: pd.Series) -> pd.Series:
        out = []
        for va, pa, la, vb, pb, lb, o in zip(v, p, l, v2, p2, l2, one):
            ea, eb = np.asarray(va, float).reshape(len(pa), -1), np.asarray(vb, float).reshape(len(pb), -1)
            d = np.sqrt(np.maximum((ea**2).sum(1)[:, None] + (eb**2).sum(1)[None, :] - 2 * ea @ eb.T, 0.0))
            if o:
                np.fill_diagonal(d, 0.0)
            rows = []
            for pos, own, labels, m in [(pa, la, lb, d)] if o else [(pa, la, lb, d), (pb, lb, la, d.T)]:
                for lab in np.unique(labels):
                    pick = labels == lab
                    sums, n = m[:, pick].sum(axis=1), int(pick.sum())
                    for i in range(len(pos)):
                        itself = 1 if o and own[i] == lab else 0
                        rows.append({"pos": int(pos[i]), "own": int(own[i]), "other": int(lab), "s": float(sums[i]), "n": n - itself})
            out.append(rows)
        return pd.Series(out)

    return run(*left, *right, same)


def silhouette(labelled: DataFrame, key: str = KEY, pos: str = POS, label: str = "label", block: int = BLOCK) -> DataFrame:
    """(key, n, n_labels, silhouette): mean silhouette with Euclidean distances; null when there is a
    single label or as many labels as sentences. Distances live in tiles, only per-label sums leave."""
    packed = labelled.select(key, pos, F.struct(F.col(pos).cast("long").alias("pos"), "vec", F.col(label).cast("int").alias("label")).alias("row"))
    t = tiles(packed, "row", key, pos, block)
    pack = lambda c: [F.flatten(c["vec"]), c["pos"], c["label"]]
    sums = (
        t.select(key, F.inline(_label_sums(pack(F.col("left")), pack(F.col("right")), F.col("same"))))
        .groupBy(key, "pos", "own", "other")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    )
    sizes = label_counts(labelled, key, label)
    return _silhouette_of(sums, key).join(sizes, key).select(key, "n", "n_labels", _valid("silhouette").alias("silhouette"))


def _silhouette_of(sums: DataFrame, key: str, *carry: str) -> DataFrame:
    """Mean silhouette per story from per-label distance sums (key, pos, own, other, s, n)."""
    mean = F.col("s") / F.nullif(F.col("n"), F.lit(0))
    kept = [F.first(c).alias(c) for c in carry]
    point = sums.groupBy(key, "pos").agg(
        F.max(F.when(F.col("own") == F.col("other"), mean)).alias("a"),
        F.min(F.when(F.col("own") != F.col("other"), mean)).alias("b"),
        *kept,
    )
    s = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    )
    return point.groupBy(key).agg(F.avg(s).alias("silhouette"), *kept)


def _valid(c: str) -> Column:
    return F.when((F.col("n_labels") > 1) & (F.col("n_labels") < F.col("n")), F.col(c))


def label_counts(labelled: DataFrame, key: str = KEY, label: str = "label") -> DataFrame:
    per = labelled.groupBy(key, label).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(key).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_labels"))


def cluster_scores(labelled: DataFrame, key: str = KEY, pos: str = POS, label: str = "label") -> DataFrame:
    """(key, cluster_density, reverse_silhouette). Noise counts as a label. Where the silhouette is
    undefined both scores are 0."""
    return _both_scores(silhouette(labelled, key, pos, label), key)


def _both_scores(s: DataFrame, key: str) -> DataFrame:
    ok = F.col("silhouette").isNotNull()
    return s.select(
        key,
        F.when(ok, F.col("n_labels") / F.col("n")).otherwise(F.lit(0.0)).alias("cluster_density"),
        F.when(ok, 1.0 - F.col("silhouette")).otherwise(F.lit(0.0)).alias("reverse_silhouette"),
    )


# --- solvers on bounded stories ------------------------------------------------------------


def gather(vectors: DataFrame, max_sentences: int = MAX_SENTENCES, key: str = KEY, pos: str = POS) -> DataFrame:
    """(key, positions, n, flat): the sentence matrix of every story inside the analysis window.

    Positions are dense from 0, so rows past the window are dropped before the shuffle and a story
    of any length sends at most ``max_sentences + 1`` rows.
    """
    head = vectors.where(F.col(pos) <= max_sentences)
    rows = head.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).cast("long").alias("p"), "vec"))).alias("it"))
    return rows.where(F.size("it") <= max_sentences).select(
        key, F.col("it.p").alias("positions"), F.size("it").alias("n"), F.flatten("it.vec").alias("flat")
    )


def _matrix(flat, n) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(int(n), -1)


def _labelled(gathered: DataFrame, method: str) -> DataFrame:
    """The gathered rows with ``labels``; the solver runs once per story."""
    if method not in S.CLUSTERERS:
        raise ValueError(f"unknown clustering {method!r}; choose from {sorted(S.CLUSTERERS)}")
    solve = S.CLUSTERERS[method]

    @F.pandas_udf("array<int>")
    def run(flat: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([solve(_matrix(f, k)).astype(int).tolist() for f, k in zip(flat, n)])

    return once(gathered, "labels", run("flat", "n"))


def cluster_labels(gathered: DataFrame, method: str, key: str = KEY) -> DataFrame:
    """(key, pos, vec, label) by ``MeanShift`` or ``HDBSCAN``."""
    width = (F.size("flat") / F.col("n")).cast("int")
    vec = F.slice(F.col("flat"), F.col("i") * F.col("_w") + 1, F.col("_w"))
    rows = _labelled(gathered, method).withColumn("_w", width)
    return rows.select(
        key, "flat", "_w", F.posexplode(F.arrays_zip(F.col("positions").alias("p"), F.col("labels").alias("l"))).alias("i", "x")
    ).select(key, F.col("x.p").alias("pos"), vec.alias("vec"), F.col("x.l").alias("label"))


def clustered_scores(gathered: DataFrame, method: str, key: str = KEY) -> DataFrame:
    """``cluster_scores`` of the solver's labels, without moving the gathered stories again."""
    side = [F.col("flat"), F.col("positions"), F.col("labels")]
    sums = _labelled(gathered, method).select(
        key, F.col("n").alias("size"), F.size(F.array_distinct("labels")).alias("n_labels"), F.inline(_label_sums(side, side, F.lit(True)))
    )
    s = _silhouette_of(sums, key, "size", "n_labels").withColumnRenamed("size", "n")
    return _both_scores(s.withColumn("silhouette", _valid("silhouette")), key)


def cluster_members(labelled: DataFrame, sentences: DataFrame, key: str = KEY, pos: str = POS, label: str = "label") -> DataFrame:
    """(key, label, pos, sentence): the sentences of each cluster as rows, in text order when sorted."""
    return labelled.select(key, pos, label).join(sentences, [key, pos])


def matrix_scores(gathered: DataFrame, regression: str = "Lasso", alpha: float = 0.01, key: str = KEY) -> DataFrame:
    """PCA, regression and elimination scores in one pass over the gathered matrices."""
    if regression not in ("Lasso", "Ridge", "ElasticNet"):
        raise ValueError(f"unknown regression {regression!r}; choose Lasso, Ridge or ElasticNet")

    @F.pandas_udf("pca double, prop double, coef double, err double, rfe double")
    def run(flat: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for f, k in zip(flat, n):
            e = _matrix(f, k)
            target = e.mean(axis=0)
            rows.append((*S.pca_scores(e), *S.regression_scores(e, target, regression, alpha), S.elimination_share(e, target)))
        return pd.DataFrame(rows, columns=["pca", "prop", "coef", "err", "rfe"])

    clean = lambda c: F.nanvl(F.col(f"s.{c}"), F.lit(None).cast("double"))
    return gathered.select(key, run("flat", "n").alias("s")).select(
        key,
        clean("pca").alias("reduction_score_PCA_explained_variance"),
        clean("prop").alias("reduction_score_PCA_prop_of_components"),
        clean("coef").alias(f"regression_coef_density_score_{regression}"),
        clean("err").alias(f"regression_error_score_{regression}"),
        clean("rfe").alias("reduction_score_Lasso"),
    )


# Renamed columns of the alternative layout.
ALTERNATIVE = {
    "reduction_score_PCA_explained_variance": "reduction_score_PCA_unexplained_variance",
    "reduction_score_Lasso": "reduction_score_RFE_Lasso",
}


def density_table(vectors: DataFrame, methods: tuple[str, ...] = ("HDBSCAN", "MeanShift"), max_sentences: int = MAX_SENTENCES,
                  alternative: bool = False, key: str = KEY, pos: str = POS) -> tuple[DataFrame, list[str]]:
    """One row for every story: its number of sentences and all density columns, and the names of the latter. The speed
    columns cover stories of any length; the scores that solvers make are null beyond the window."""
    g = gather(vectors, max_sentences, key, pos)
    out = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("num_sentences"))
    if alternative:
        out = out.join(trajectory_score(vectors, key, pos), key, "left")
    else:
        speed = narrative_speed(vectors, key=key, pos=pos)
        out = out.join(
            speed.select(key, F.col("speed").alias("narrative_speed_score"), F.col("speed_norm").alias("narrative_speed_score_norm")), key, "left"
        )
    out = out.join(matrix_scores(g, key=key), key, "left")
    for m in methods:
        c = clustered_scores(g, m, key)
        out = out.join(
            c.select(key, F.col("cluster_density").alias(f"cluster_density_score_{m}"), F.col("reverse_silhouette").alias(f"cluster_reverse_silhouette_score_{m}")), key, "left"
        )
    if alternative:
        out = out.withColumnsRenamed(ALTERNATIVE)
    return out, [c for c in out.columns if c not in (key, "num_sentences")]

"""Training and model inspection with Spark ML."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rowstats import columns_matching
from .evaluation import accuracy_f1, confusion, group_split
from .permute import shuffled_donors

# The search grid. Spark trees have no minimum split size; the draw keeps the parameter so
# that the grid has its 288 points, and trees use the leaf size.
GRID = {
    "n_estimators": [50, 100, 200, 300],
    "max_depth": [None, 10, 20, 30],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "bootstrap": [True, False],
}
DEEPEST = 30  # Spark's limit for tree depth


def feature_sets(df: DataFrame) -> dict[str, list[str]]:
    """The five feature sets by column name."""
    models = "(sentence_sim|w2v|glove|fast_text)(.*)"
    density = columns_matching(df, "score")
    mean, std = columns_matching(df, models + "(mean)"), columns_matching(df, models + "(std)")
    return {"sim_features": mean + std, "density_features": density, "mean_sim_metrics": mean, "std_sim_metrics": std, "all_features": density + mean + std}


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")


def vectorise(df: DataFrame, features: list[str]) -> DataFrame:
    """Add the ``features`` vector; missing values become 0 after NaN is mapped to null."""
    parts = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in features]
    return df.withColumn("features", array_to_vector(F.array(*parts)))


def forest(params: dict | None = None, seed: int = 42) -> RandomForestClassifier:
    p = params or {}
    return RandomForestClassifier(
        labelCol="label", featuresCol="features", seed=seed, numTrees=p.get("n_estimators", 100), maxDepth=min(p.get("max_depth") or DEEPEST, DEEPEST),
        minInstancesPerNode=p.get("min_samples_leaf", 1), bootstrap=p.get("bootstrap", True),
    )


def boosted(seed: int = 42, rounds: int = 20) -> OneVsRest:
    return OneVsRest(classifier=GBTClassifier(seed=seed, maxIter=rounds), labelCol="label", featuresCol="features")


def train_and_evaluate(df: DataFrame, sets: dict[str, list[str]], target: str, group: str, n_classes: int, params: dict[str, dict] | None = None,
                       kind: str = "forest", seed: int = 42, rounds: int = 20) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Fit one model per feature set on the same group split. Returns (name, accuracy, f1_score) rows and
    the confusion table of each set (codes as text)."""
    if kind not in ("forest", "boosted"):
        raise ValueError("kind must be forest or boosted")
    split = group_split(df, group, seed=str(seed)).withColumn("label", F.col(target).cast("double"))
    labels = [str(i) for i in range(n_classes)]
    table, cms = None, {}
    for name, cols in sets.items():
        require(df, [*cols, target])
        data = vectorise(split, cols).select("label", "features", "is_test")
        est = forest((params or {}).get(name), seed) if kind == "forest" else boosted(seed, rounds)
        model = est.fit(data.where(~F.col("is_test")))
        out = model.transform(data.where("is_test"))
        pairs = out.select(F.col("label").cast("int").cast("string").alias("true"), F.col("prediction").cast("int").cast("string").alias("pred"))
        cms[name] = confusion(pairs, labels)
        part = accuracy_f1(cms[name]).select(F.lit(name).alias("features_name"), "accuracy", "f1_score")
        table = part if table is None else table.unionByName(part)
    return table, cms


def permutation_importance(model, test: DataFrame, features: list[str], row_id: str, label: str = "label", repeats: int = 10, seed: str = "42") -> DataFrame:
    """(feature, importance, std): drop in accuracy when one column is shuffled, over ``repeats`` shuffles.
    All (repeat, feature) variants are scored in one transform."""
    vals = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    base = test.select(row_id, label, vals.alias("own")).withColumn("own", F.transform("own", lambda x: F.coalesce(x, F.lit(0.0))))
    plain = model.transform(base.withColumn("features", array_to_vector("own"))).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("acc")).first()["acc"]
    donors = shuffled_donors(base, row_id, repeats, seed)
    other = base.select(F.col(row_id).alias("donor"), F.col("own").alias("theirs"))
    mixed = base.join(donors, row_id).join(other, "donor").select(
        "repeat", label, "own", "theirs", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("f")
    )
    changed = F.transform(F.col("own"), lambda x, i: F.when(i == F.col("f"), F.get(F.col("theirs"), F.col("f"))).otherwise(x))
    scored = model.transform(mixed.withColumn("features", array_to_vector(changed)))
    acc = scored.groupBy("f", "repeat").agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("acc"))
    name = F.element_at(F.array(*[F.lit(x) for x in features]), F.col("f") + 1)
    return acc.groupBy("f").agg(F.avg(F.lit(plain) - F.col("acc")).alias("importance"), F.stddev_pop("acc").alias("std")).select(name.alias("feature"), "importance", "std")


def stratified_folds(df: DataFrame, group: str, target: str, k: int = 3, block_groups: int = 50_000) -> DataFrame:
    """Add ``fold``: whole groups, largest class imbalance first, each to the fold where the class counts
    stay most even. Works on the group x class histogram, one row per group. Groups are dealt by hash into
    blocks of about ``block_groups``, each balanced on its own task, so the folds are even for any number."""
    hist = df.groupBy(group).pivot(target).count().na.fill(0)
    names = [c for c in hist.columns if c != group]
    blocks = hist.count() // block_groups + 1

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_name=pdf[group].astype(str))
        counts = pdf[names].to_numpy(float)
        total, load = np.maximum(counts.sum(axis=0), 1), np.zeros((k, len(names)))
        folds = np.zeros(len(pdf), int)
        for i in sorted(range(len(pdf)), key=lambda i: (-counts[i].std(), pdf["_name"].iloc[i])):
            uneven = [(np.std((load + np.eye(k)[f][:, None] * counts[i]) / total, axis=0).mean(), load[f].sum(), f) for f in range(k)]
            folds[i] = min(uneven)[2]
            load[folds[i]] += counts[i]
        return pd.DataFrame({group: pdf[group], "fold": folds})

    schema = T.StructType([hist.schema[group], T.StructField("fold", T.IntegerType())])
    dealt = hist.withColumn("_block", F.pmod(F.xxhash64(group), F.lit(blocks)))
    table = dealt.groupBy("_block").applyInPandas(assign, schema)
    return df.join(table, group)


def hash_folds(df: DataFrame, group: str, k: int = 3, seed: str = "42") -> DataFrame:
    """Folds by hash of the group: no group table, for any number of groups."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (h % k).cast("int"))


def random_search(df: DataFrame, features: list[str], target: str, group: str, draws: int = 200, folds: int = 3, grid: dict | None = None, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """(rank, parameters, mean weighted F1) of random grid points, cross-validated on grouped folds."""
    require(df, [*features, target, group])
    g = grid or GRID
    points = [dict(zip(g, v)) for v in itertools.product(*g.values())]
    picked = random.Random(seed).sample(points, min(draws, len(points)))
    data = vectorise(stratified_folds(df, group, target, folds), features).select(F.col(target).cast("double").alias("label"), "features", "fold")
    est = forest()
    maps = []
    for p in picked:
        f = forest(p)
        maps.append({est.numTrees: f.getNumTrees(), est.maxDepth: f.getMaxDepth(), est.minInstancesPerNode: f.getMinInstancesPerNode(), est.bootstrap: f.getBootstrap()})
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName="f1"), foldCol="fold", numFolds=folds, parallelism=parallelism)
    scores = cv.fit(data).avgMetrics
    rows = sorted(((float(s), *[str(p[k]) for k in g]) for s, p in zip(scores, picked)), reverse=True)
    schema = "rank int, mean_f1 double, " + ", ".join(f"{k} string" for k in g)
    return df.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], schema)

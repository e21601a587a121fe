"""Classifier evaluation from counted (true, predicted) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from .ordered import smallest_by_hash

# Temperature order used to compare labels.
BAND_ORDER = {"low": 1, "medium": 2, "high": 3}
CONTEXTS = ("low_temperature", "medium_temperature", "high_temperature")


def confusion(pred: DataFrame, labels: list[str], true: str = "true", predicted: str = "pred") -> DataFrame:
    """(true, pred, n) for every pair of labels, empty cells included. Rows are counted first; the grid of
    labels is a literal table."""
    counts = pred.groupBy(F.col(true).alias("true"), F.col(predicted).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(x) for x in labels])
    grid = pred.sparkSession.range(1).select(F.explode(names).alias("true")).select("true", F.explode(names).alias("pred"))
    return grid.join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def normalised(cm: DataFrame) -> DataFrame:
    """Share of each prediction within its true class; null for a class without rows."""
    return cm.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(W.partitionBy("true")), F.lit(0)))


def class_report(cm: DataFrame) -> DataFrame:
    """precision, recall, F1 and support per class; undefined ratios are 0."""
    hit = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    rows = cm.groupBy(F.col("true").alias("label")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    cols = cm.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return rows.join(cols, "label").select(
        "label",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def accuracy_f1(cm: DataFrame) -> DataFrame:
    """Accuracy and support-weighted F1, one row."""
    r = class_report(cm)
    total = F.sum("support")
    return r.agg((F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_score"))


def _parts(cm: DataFrame) -> DataFrame:
    order = lambda c: L.lookup(L.label_band(F.col(c)), BAND_ORDER)
    return cm.select(
        "true", "pred", "n", order("true").alias("tt"), order("pred").alias("pt"),
        (L.label_paraphrase(F.col("true")) == "with_paraphrase").alias("tp"), (L.label_paraphrase(F.col("pred")) == "with_paraphrase").alias("pp"),
        F.sum("n").over(W.partitionBy("true")).alias("class_size"),
    )


def adjusted_errors(cm: DataFrame) -> DataFrame:
    """(category, errors, possible, rate): errors over class size times eligible wrong labels, in percent;
    0 without an eligible label."""
    p = _parts(cm)
    cond: dict[str, Column] = {
        "paraphrase": (F.col("tt") == F.col("pt")) & (F.col("tp") != F.col("pp")),
        "temperature": (F.col("tt") != F.col("pt")) & (F.col("tp") == F.col("pp")),
        "dissociate": (~F.col("tp") & F.col("pp") & (F.col("pt") > F.col("tt"))) | (F.col("tp") & ~F.col("pp") & (F.col("tt") > F.col("pt"))),
    }
    aggs = []
    for k, c in cond.items():
        aggs += [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("bigint")).alias(f"{k}_e"), F.coalesce(F.sum(F.when(c, F.col("class_size"))), F.lit(0).cast("bigint")).alias(f"{k}_p")]
    rate = lambda k: F.coalesce(F.lit(100.0) * F.col(f"{k}_e") / F.nullif(F.col(f"{k}_p"), F.lit(0)), F.lit(0.0))
    return p.agg(*aggs).select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("category"), F.col(f"{k}_e").alias("errors"), F.col(f"{k}_p").alias("possible"), rate(k).alias("rate")) for k in cond]))
    )


def error_shares(cm: DataFrame) -> DataFrame:
    """(category, errors, share): paraphrase, temperature or both wrong, as percent of all errors."""
    p = _parts(cm)
    same_t, same_p = F.col("tt") == F.col("pt"), F.col("tp") == F.col("pp")
    cond = {"paraphrase": same_t & ~same_p, "temperature": ~same_t & same_p, "both": ~same_t & ~same_p}
    total = F.sum(F.when(F.col("true") != F.col("pred"), F.col("n")))
    agg = p.agg(total.alias("total"), *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("bigint")).alias(k) for k, c in cond.items()])
    share = lambda k: F.coalesce(F.lit(100.0) * F.col(k) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return agg.select(F.inline(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("errors"), share(k).alias("share")) for k in cond])))


def context_auc(cm: DataFrame, contexts: tuple[str, ...] = CONTEXTS) -> DataFrame:
    """(context, auc) of the paraphrase decision within each temperature band.

    The weighted (label, score) table follows the analysis: predictions of the context's two labels for
    rows of other classes count as label 1, score 0. Null when one label is absent.
    """
    rows = []
    for ctx in contexts:
        yes, no = F.lit(f"{ctx}_with_paraphrase"), F.lit(f"{ctx}_with_no_paraphrase")
        t, p = F.col("true"), F.col("pred")
        inside = p.isin(f"{ctx}_with_paraphrase", f"{ctx}_with_no_paraphrase")
        w = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
        pos1, neg1 = w((t == yes) & (p == yes)), w((t == yes) & (p == no))
        neg0 = w((t == no) & (p == no))
        pos0 = w(((t == no) & (p == yes)) | (~t.isin(f"{ctx}_with_paraphrase", f"{ctx}_with_no_paraphrase") & inside))
        auc = (pos1 * neg0 + (pos1 * neg1 + pos0 * neg0) / 2) / F.nullif((pos1 + pos0) * (neg1 + neg0), F.lit(0.0))
        rows.append((ctx, auc))
    wide = cm.agg(*[a.alias(c) for c, a in rows])
    return wide.unpivot([], [c for c, _ in rows], "context", "auc")


def undersample(df: DataFrame, target: str, row_id: str, seed: str = "42") -> DataFrame:
    """Every class cut to the size of the smallest, keeping the rows with the smallest hash."""
    smallest = df.groupBy(target).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("k")).scalar()
    return smallest_by_hash(df, target, row_id, smallest, seed)


def group_split(df: DataFrame, group: str, share: float = 0.2, seed: str = "42") -> DataFrame:
    """Add ``is_test``: ceil(share x groups) whole groups, drawn by hash, form the test set."""
    groups = df.select(group).distinct()
    test = smallest_by_hash(groups, None, group, F.ceil(F.col("_total") * share), seed).withColumn("_t", F.lit(True))
    return df.join(test, group, "left").withColumn("is_test", F.coalesce("_t", F.lit(False))).drop("_t")

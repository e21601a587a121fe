"""Views of the given tables that stand for the inputs of the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread, table


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")


def stories(spark: SparkSession, d: str) -> DataFrame:
    """documents as a corpus: (story_id, altered_text, prompt, llm_model)."""
    return documents(spark, d).select(
        F.col("doc_id").alias("story_id"),
        F.col("text").alias("altered_text"),
        F.col("lang").alias("prompt"),
        F.col("source").alias("llm_model"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations as sentence rows: (story_id, pos, sentence)."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("story_id"), F.col("turn").alias("pos"), F.col("text").alias("sentence")
    )


def turn_tokens(spark: SparkSession, d: str) -> DataFrame:
    return spread(turns(spark, d), "story_id", "pos").select(
        "story_id", "pos", T.word_tokens(F.col("sentence")).alias("tokens")
    )


def story_vectors(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as stories of eight sentence vectors: (story_id, pos, vec, label)."""
    return table(spark, d, "embeddings").select(
        F.expr("vec_id div 8").alias("story_id"),
        (F.col("vec_id") % 8).alias("pos"),
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
    )


def vector_slot(token: Column, n: Column) -> Column:
    """Row of the vector table that stands for a token."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % n


def word_vectors(spark: SparkSession, d: str, tokens: DataFrame) -> DataFrame:
    """Word-vector table (token, vec) over the distinct tokens longer than one character."""
    vecs = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("slot"), F.col("embedding").cast("array<double>").alias("vec")
    )
    n = vecs.agg(F.count(F.lit(1)).alias("n_vec")).scalar()
    words = tokens.select(F.explode("tokens").alias("token")).distinct().where(F.length("token") > 1)
    slotted = words.select("token", vector_slot(F.col("token"), n).alias("slot"))
    return slotted.join(vecs, "slot").select("token", "vec")


def subject_values(spark: SparkSession, d: str) -> DataFrame:
    """events of the two conditions, one row per subject and condition with two features."""
    return (
        table(spark, d, "events")
        .where(F.col("event_type").isin("click", "purchase"))
        .groupBy(F.col("user_id").alias("subj"), F.when(F.col("event_type") == "click", "routine").otherwise("cinderella").alias("stim"))
        .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).cast("double").alias("n_events"))
    )


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def features(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a feature table with a row key, a binary and a three-valued target."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", *FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("is_r")
    )


def spread_features(spark: SparkSession, d: str) -> DataFrame:
    """The same for rank statistics, whose per-row work deserves every core."""
    return spread(features(spark, d), "l_orderkey")


def paraphrase_index(n: Column, story: Column) -> tuple[Column, Column]:
    """Deterministic pair: the paraphrase is the last sentence, its source any earlier one."""
    return story % (n - 1), n - 1


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents with their labels: (doc_id, source, quality, toxic, n_chars, text)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    return docs.join(table(spark, d, "labels"), "doc_id")


# six classes = length band x quality, with a fixed rule as prediction
def predictions(spark: SparkSession, d: str) -> DataFrame:
    band = lambda a, b: F.when(F.col("n_chars") < a, "low").when(F.col("n_chars") < b, "medium").otherwise("high")
    para = lambda c: F.when(c, "paraphrase").otherwise("no_paraphrase")
    name = lambda t, p: F.concat(t, F.lit("_temperature_with_"), p)
    return labelled(spark, d).select(
        "doc_id",
        "source",
        name(band(800, 2500), para(F.col("quality") == 1)).alias("true"),
        name(band(1000, 2000), para(F.col("toxic") == 0)).alias("pred"),
    )


CLASSES = [f"{t}_temperature_with_{p}" for t in ("high", "low", "medium") for p in ("no_paraphrase", "paraphrase")]

"""Small table steps and the compositions of the analysis that put operators in sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import store
from . import cleaning as CL
from . import corpus as K
from . import distances as D
from .encode import Encoder, encode_distinct
from .heavy import split_join


def fill_missing(df: DataFrame, columns: list[str], value: float = -1.0) -> DataFrame:
    """Null and NaN become ``value``."""
    known = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))
    return df.withColumns({c: F.coalesce(known(c), F.lit(value)) for c in columns})


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN in ``columns``."""
    return df.na.drop(subset=columns)


def several_vectors(vectors: DataFrame, key: str = "story_id", vec: str = "vec", least: int = 2) -> DataFrame:
    """Rows of the stories with at least ``least`` vectors that are not null."""
    known = vectors.groupBy(key).agg(F.count(vec).alias("_n")).where(F.col("_n") >= least).select(key)
    return vectors.where(F.col(vec).isNotNull()).join(known, key, "left_semi")


def length_normalised(df: DataFrame, score: str, n: str, out: str) -> DataFrame:
    """``score`` over the number of sentences; null for none."""
    return df.withColumn(out, F.col(score) / F.nullif(F.col(n), F.lit(0)))


def lemmatise(tokens: DataFrame, lemmas: DataFrame, token: str = "token", lemma: str = "lemma") -> DataFrame:
    """Add ``lemma``: the entry of the lemma table (token, lemma; a token once), else the token itself. Frequent tokens are
    looked up apart from the rest, so they do not meet in one task."""
    table = lemmas.select(F.col(token), F.col(lemma).alias("_lemma"))
    return split_join(tokens, table, token, ["_lemma"]).withColumn(lemma, F.coalesce("_lemma", token)).drop("_lemma")


def sentence_features(stories: DataFrame, encoders: dict[str, Encoder], key: str = "story_id", text: str = "altered_text", more_than: int = 2,
                      metrics: dict[str, list[str]] | None = None) -> DataFrame:
    """Split, count, keep the stories of more than ``more_than`` sentences, encode each distinct sentence once per
    model, and summarise the distances: one row per story, stories of any length. Sentences and vectors are stored, as the
    distances read them many times: the splitter and the encoders run once."""
    split = T.with_sentences(stories.select(key, text), text).withColumn("num_sentences", F.size("sentences"))
    kept = store(split.where(F.col("num_sentences") > more_than).select(key, "sentences", "num_sentences"))
    rows = kept.select(key, F.posexplode("sentences").alias("pos", "sentence"))
    encoded = {name: store(encode_distinct(rows, encoder, (key, "pos"))) for name, encoder in encoders.items()}
    wide = D.feature_table(encoded, metrics, key)
    return kept.select(key, "num_sentences").join(wide, key)


def labelled_story_table(stories: DataFrame, temperature: str = "temperature", row_id: str = "index", code: str = "combined_label", out: str = "cat_label") -> DataFrame:
    """Label the cleaned stories, add the random control column and the integer code of the combined label."""
    return CL.category_codes(K.add_labels(stories, temperature, row_id), code, out)

"""Corpora built from split texts: what is split already is not split again, and gives the same rows."""

import pytest
from pyspark.sql import functions as F

from proseweave.functions import text as T
from proseweave.operators import corpus as K

TEXTS = [
    (1, "Dr. Who came at 3.5 p.m. today. He left... Soon? Mr. X. went to Acme Inc. It stayed.", [0, 3]),
    (2, "One. Two. Three.", [1, 2]),
    (3, "Only one", []),
    (4, None, []),
    (5, "", []),
    (6, "A. B. C. D", [0, 1]),
]


@pytest.fixture()
def runs(spark):
    rows = spark.createDataFrame(TEXTS, "story_id long, altered_text string, clean_paraphrase_index array<int>")
    return T.with_sentences(rows, "altered_text", "held").withColumn("clean_paraphase_type", F.lit(1))


def _found(df):
    return sorted(df.collect(), key=str)


def test_sentences_that_are_there_give_the_same_rows(spark, runs):
    keep, plain = ["story_id"], runs.drop("held")
    want = K.control_corpus(plain, keep)
    got = K.control_corpus(runs, keep, "held")
    assert _found(got) == _found(want) and want.count() == 3
    other = spark.createDataFrame([(9, "An outside story. It has two.")], "story_id long, altered_text string")
    for low, high in ((None, None), (1, 20)):
        a = K.enrich(plain, want, other, low, high)
        b = K.enrich(runs, want, other, low, high, sentences="held").drop("held")
        columns = sorted(a.columns)
        assert sorted(b.columns) == columns and _found(b.select(columns)) == _found(a.select(columns))
        c = K.enrich(runs.withColumnRenamed("held", "sentences"), want, other, low, high, sentences="sentences")
        assert _found(c.select(columns)) == _found(a.select(columns))


def test_the_splitter_runs_once_for_each_text(spark, runs, monkeypatch):
    seen, plain = [], T.sentences
    monkeypatch.setattr(T, "sentences", lambda text: (seen.append(text), plain(text))[1])
    control = K.control_corpus(runs, ["story_id"], "held")
    assert not seen
    K.enrich(runs, control, None, sentences="held")
    assert len(seen) == 1  # the controls are new texts


def test_sentence_features_read_stored_sentences(spark):
    from proseweave.operators import compose, encode

    stories = spark.createDataFrame([(1, "One two. Two three. Three one. Two."), (2, "Just one."), (3, None)], "story_id long, altered_text string")
    encoder = lambda df: df.select("sentence", encode.hashed_bag(T.word_tokens(F.col("sentence")), 8).alias("vec"))
    out = compose.sentence_features(stories, {"hashed": encoder})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "regexp_extract_all" not in plan
    assert [(r.story_id, r.num_sentences) for r in out.collect()] == [(1, 4)]

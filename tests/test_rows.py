"""No row is lost or doubled: nulls, ties, repeated values; tails at any size."""

import math

import pytest
from pyspark.sql import functions as F

from proseweave.functions import tails as T
from proseweave.operators import compose, corpus, encode, learn, ordered, stats, tables
from proseweave.streaming import resumable


def test_encode_distinct_keeps_null_and_unknown_sentences(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "b"), (2, 1, "a")], "story_id int, pos int, sentence string")
    coder = lambda df: df.where("sentence = 'a'").select("sentence", F.array(F.lit(1.0)).alias("vec"))
    got = {(r.story_id, r.pos): r.vec for r in encode.encode_distinct(rows, coder).collect()}
    assert got == {(1, 0): [1.0], (1, 1): None, (2, 0): None, (2, 1): [1.0]}


def test_robust_scale_keeps_rows_without_a_group(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), (None, 10.0), (None, 20.0), (None, 30.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = sorted(((r.g, r.x) for r in stats.robust_scale(df, ["x"], "g").collect()), key=str)
    assert got == sorted([("a", -1.0), ("a", 0.0), ("a", 1.0), (None, -1.0), (None, 0.0), (None, 1.0)], key=str)


def test_shuffles_are_permutations_even_with_equal_hashes(spark, monkeypatch):
    rows = spark.createDataFrame([(i,) for i in range(60)], "id int")
    monkeypatch.setattr(learn.F, "conv", lambda c, a, b: F.lit("3") if (a, b) == (16, 10) else c)  # all hashes equal
    got = learn.shuffled_donors(rows, "id", 3).collect()
    for k in range(3):
        assert sorted(r.id for r in got if r.repeat == k) == sorted(r.donor for r in got if r.repeat == k) == list(range(60))


def test_paraphrases_keep_rows_without_a_sentence(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "z")], "id int, s string")
    out = corpus.paraphrase_distinct(df, "s", lambda t: t.where("sentence <> 'z'").withColumn("paraphrase", F.upper("sentence")))
    assert {(r.id, r.paraphrase) for r in out.collect()} == {(1, "A"), (2, None), (3, "A"), (4, None)}


def test_rank_table_with_null_group_and_many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as shuffle partitions
    try:
        rows = [(g, float(v % 37)) for g in (None, "a", "b") for v in range(200)] + [("a", None), ("a", math.nan)]
        got = {(r.feature, r.value): (r.n, r.before, r.total) for r in ordered.rank_table(spark.createDataFrame(rows, "feature string, value double")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for g in (None, "a", "b"):
        values = sorted(float(v % 37) for v in range(200))
        assert {v: got[g, v] for v in set(values)} == {v: (values.count(v), sum(x < v for x in values), 200) for v in set(values)}


def test_kendall_tail():
    # counted by hand: 4 rows in order, 1 of 24 permutations on either side
    assert T.kendall_two_sided(6, 0.0, 4, False) == pytest.approx(2 / 24)
    assert T.kendall_two_sided(0, 0.0, 4, False) == 1.0
    assert T.kendall_two_sided(10, 25.0, 50, True) == pytest.approx(T.norm_two_sided(2.0))


def test_tails_hold_at_size():
    for n in (57, 1e4, 1e7, 1e9):
        assert T.f_tail(2.0, 2, n) == pytest.approx(math.exp(-n / 2 * math.log1p(4 / n)), rel=1e-8)
    assert T.t_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-8)


def test_small_steps(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, math.nan)], "id int, x double")
    assert [r.x for r in compose.fill_missing(df, ["x"]).orderBy("id").collect()] == [1.0, -1.0, -1.0]
    assert compose.complete_rows(df, ["x"]).count() == 1
    assert sorted(r.id for r in tables.shuffled(df, "id").collect()) == [1, 2, 3]
    assert [r.y for r in compose.length_normalised(df.withColumn("n", F.lit(0)), "x", "n", "y").collect()] == [None] * 3


def test_resumable_enrichment_reports_a_wrong_key(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert resumable.enrich_new_rows(df, lambda x: x, path, "id") == 2
    assert resumable.enrich_new_rows(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), lambda x: x, path, "id") == 1
    with pytest.raises(Exception, match="nope"):
        resumable.enrich_new_rows(df.withColumn("nope", F.lit(1)), lambda x: x, path, "nope")
    assert spark.read.parquet(path).count() == 3

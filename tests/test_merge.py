"""Merging on text: the rows of a plain join, and copies that stay counts."""

from collections import Counter

from pyspark.sql import functions as F

from proseweave.operators import tables as TB


def test_rows_like_a_plain_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "c")], "id int, text string")
    right = spark.createDataFrame([("a", 1, 7), ("a", 1, 7), ("a", 2, 7), ("", 3, 7), (None, 4, 7), ("d", 5, 7)], "text string, W int, id int")
    want = Counter(map(tuple, left.join(right.select("text", "W"), "text").select("text", "id", "W").collect()))
    assert Counter(map(tuple, TB.merge_on_text(left, right, "text").collect())) == want
    assert Counter(map(tuple, TB.merge_on_text(left, right, "text", ["W"]).collect())) == want
    counts = {(r.text, r.id, r.W): r.n for r in TB.merged_counts(left, right, "text", ["W"]).collect()}
    assert counts == dict(want)


def test_copies_do_not_multiply_rows(spark):
    left = spark.range(10_000).select(F.lit("one text").alias("text"), (F.col("id") % 3).alias("kind"))
    right = spark.range(10_000).select(F.lit("one text").alias("text"), F.lit(5).alias("W"))
    rows = TB.merged_counts(left, right, "text").collect()
    assert sorted((r.kind, r.W, r.n) for r in rows) == [(0, 5, 33_340_000), (1, 5, 33_330_000), (2, 5, 33_330_000)]
    assert TB.merge_on_text(left.limit(0), right, "text").count() == 0

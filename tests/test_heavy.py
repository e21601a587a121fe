"""Misra-Gries bounds, and a join whose tasks stay even when one value holds half of the rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proseweave.operators import heavy as H


def test_summary_bounds():
    rng = random.Random(1)
    for capacity in (3, 10, 50):
        values = [int(rng.paretovariate(0.7)) for _ in range(5000)]
        seen, real = H.Summary(capacity), Counter(values)
        for k in range(0, len(values), 37):
            seen.add(values[k : k + 37])
            assert len(seen.counts) <= 2 * capacity
        seen.reduce()
        assert len(seen.counts) <= capacity
        for value, n in real.items():
            assert n - len(values) / (capacity + 1) <= seen.counts.get(value, 0) <= n


def rows_of(spark, n=60_000):
    return spark.range(n, numPartitions=8).select(
        "id", F.when(F.col("id") % 2 == 0, "the").when(F.col("id") % 10 == 1, "of").when(F.col("id") % 97 == 5, F.lit(None)).otherwise(F.concat(F.lit("w"), (F.col("id") * 7919 % 9973).cast("string"))).alias("token")
    )


def test_heavy_values(spark):
    assert H.heavy_values(rows_of(spark), "token", 0.05) == ["the", "of"]
    assert H.heavy_values(rows_of(spark).limit(0), "token", 0.05) == []
    with pytest.raises(ValueError):
        H.heavy_values(rows_of(spark), "token", 0.0001)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_like_a_join(spark, how):
    rows = rows_of(spark, 5000)
    table = rows.select("token").distinct().where("token is not null and token <> 'of' and hash(token) % 3 <> 0 or token = 'the'").withColumn("vec", F.length("token"))
    got = H.split_join(rows, table, "token", ["vec"], how=how)
    assert got.columns == ["id", "token", "vec"]
    want = rows.join(table, "token", how).select("id", "token", "vec")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_a_repeated_key_is_refused(spark):
    table = spark.createDataFrame([("the", 1), ("the", 2), ("of", 1), ("of", 2)], "token string, vec int")
    with pytest.raises(ValueError, match="unique"):
        H.split_join(rows_of(spark), table, "token", ["vec"])


def test_tasks_stay_even(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = rows_of(spark)
        table = rows.select("token").distinct().where("token is not null").withColumn("vec", F.length("token"))
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        plain = sizes(rows.where("token is not null").join(table, "token"))
        even = sizes(H.split_join(rows, table, "token", ["vec"], how="inner"))
        assert plain[-1] > 3 * plain[len(plain) // 2]
        assert even[-1] <= 2 * even[len(even) // 2]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)

"""Quoted line breaks read split by split: the same rows as the one-task reader."""

import random

import pytest
from pyspark.sql import types as T

from proseweave.sources import corpora as C
from proseweave.sources import quoted as Q

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("last", T.StringType())])


def made(seed, n=300):
    pick = random.Random(seed)
    words = ["a", 'say "so"', "x,y", "\n", "\n\n", '"', "\r\n", "long " * 12, "é", ";\n,\""]
    return [(i, "t" + "".join(pick.choice(words) for _ in range(pick.randrange(9))) + "e", pick.choice(["z", None, 'q"\nq'])) for i in range(n)]


@pytest.mark.parametrize("size,limit", [(97, 10**6), (700, 0), (1 << 20, 10**6)])
def test_same_rows_as_one_task(spark, tmp_path, size, limit):
    rows = made(size)
    path = str(tmp_path / "f")
    C.write_delimited(spark.createDataFrame(rows, SCHEMA).repartition(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = Q.read_quoted(spark, path, ",", SCHEMA, limit)
        assert got.schema.names == SCHEMA.names
        found = sorted(map(tuple, got.collect()), key=str)
        if size < 1000:
            assert Q._lines(spark, path).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted(rows, key=str)
    one_task = spark.read.options(header=True, multiLine=True, quote='"', escape='"').schema(SCHEMA).csv(path)
    assert found == sorted(map(tuple, one_task.collect()), key=str)


def test_edges(spark, tmp_path):
    path = tmp_path / "e.csv"
    # line ends of two signs, a header over two lines, blank lines, no line end after the last record
    path.write_bytes(b'"a\nb",c\r\n1,"x\r\ny"\r\n\r\n2,z\r\n3,"open ""q""\n\n"')
    for size in (3, 1000):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted(map(tuple, Q.read_quoted(spark, str(path), ",").collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == [("1", "x\r\ny"), ("2", "z"), ("3", 'open "q"\n\n')]
    (tmp_path / "h.csv").write_text("a,b\n")
    assert C.read_delimited(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "n.csv").write_text("")
    assert Q.quoted_records(spark, str(tmp_path / "n.csv"), True).collect() == []

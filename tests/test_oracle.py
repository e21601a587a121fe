"""Every registered query against its SQL statement in DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, FOLDER)
    cols, types = sorted(df.columns), dict(df.dtypes)
    ours = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert {d[0]: str(d[1]) for d in res.description} == {c: TYPES[types[c]] for c in cols}
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(_cell(r[i]) for i in at) for r in res.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

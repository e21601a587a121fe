"""Heap-ordered bounds against plain rounds over all distances, and the defined cases."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from proseweave.llm import centroids as cn


def plain(rows, dims, clusters, rounds, scale, seed):
    kept = [(key, [math.floor(scale * x) for x in v]) for key, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    at = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(at)), key=lambda c: (dist(v, at[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        at = [[sum(col) // n for col in zip(*mine)] if (n := len(mine := [v for (_, v), o in zip(kept, own) if o == c])) else at[c] for c in range(len(at))]
    own = [nearest(v) for _, v in kept]
    d = [dist(v, at[o]) for (_, v), o in zip(kept, own)]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return Counter((key, o, x, sum(y for y, p in zip(d, own) if p == o), sum(d), name[o]) for (key, _), o, x in zip(kept, own, d))


def made(n, dims, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    return [(int(k), (centers[k % 6] + spread * rng.normal(size=dims)).tolist()) for k in range(n)]


@pytest.mark.parametrize("clusters,rounds,scale,block", [(8, 10, 1024, 37), (3, 4, 8, 4096), (1, 2, 1024, 50), (8, 1, 2, 10)])
def test_like_plain_rounds(spark, monkeypatch, clusters, rounds, scale, block):
    monkeypatch.setattr(cn, "BLOCK", block)
    rows = made(300, 4, clusters) + [(1, [0.5, 0.5, -0.5, 0.0])] * 40 + [(None, [1.0, 0.0, 0.0, 0.0])] * 2
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "'x' as id", "2 as block", "3L as moves").repartition(5)
    got = cn.assignments(df, dims=4, clusters=clusters, rounds=rounds, scale=scale)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, 4, clusters, rounds, scale, cn.SEED)


def test_few_empty_and_large(spark):
    kind = "vec_id long, embedding array<float>"
    assert cn.assignments(spark.createDataFrame([], kind)).count() == 0
    assert cn.assignments(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = cn.assignments(spark.createDataFrame([(5, [0.25, -0.25])], kind), dims=2).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(5, 0, 0, 0)]
    with pytest.raises(Exception, match="beyond"):
        cn.assignments(spark.createDataFrame([(1, [3e30, 0.0])], kind), dims=2)


def test_most_rows_are_never_looked_at_again(spark):
    df = spark.createDataFrame(made(3000, 16, 5, 0.05), "vec_id long, embedding array<double>")
    found = cn.cluster(df, dims=16, rounds=6)
    assert found.scanned[0] == 3000 and sum(found.scanned[3:]) < 3000


def test_rounds_shuffle_no_vectors(spark):
    store = cn.Store(spark)
    made_blocks = spark.createDataFrame([(1, bytearray(8)), (2, bytearray(8))], "block long, vectors binary")
    state = spark.createDataFrame([(1, bytearray(4), bytearray(8)), (2, bytearray(4), bytearray(8))], "block long, clusters binary, keys binary")
    blocks, heaps = store.bucketed(made_blocks, "blocks", 4), store.bucketed(state, "round0", 4)
    plan = cn._beside(blocks, heaps)._jdf.queryExecution().executedPlan().toString()
    store.drop("blocks"), store.drop("round0")
    assert "SortMergeJoin" in plan and "Exchange" not in plan

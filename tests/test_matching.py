"""Caliper matching against a plain greedy pass, for any ranges; ties, hot scores, long chains."""

import random

import pytest
from pyspark.sql import functions as F

from proseweave.operators import matching as MT


def plain(rows, caliper):
    """Equal scores by id first; then the neighbours of least (gap, hash), one pair at a time."""
    pairs, by_score = [], {}
    for key, t, s in rows:
        by_score.setdefault(s, ([], []))[t].append(key)
    rest = []
    for s, (controls, treated) in by_score.items():
        n = min(len(controls), len(treated))
        pairs += [(a, b, 0.0) for a, b in zip(sorted(treated)[:n], sorted(controls)[:n])]
        rest += [(s, str(k), 0, k) for k in sorted(controls)[n:]] + [(s, str(k), 1, k) for k in sorted(treated)[n:]]
    rest.sort()
    while True:
        best = None
        for x, y in zip(rest, rest[1:]):
            if x[2] != y[2] and y[0] - x[0] <= caliper:
                a, b = (x, y) if x[2] else (y, x)
                best = min(best or (9e9,), (y[0] - x[0], MT.pair_hash(a[1], b[1]), a, b))
        if best is None:
            return sorted(pairs)
        pairs.append((best[2][3], best[3][3], best[0]))
        rest = [r for r in rest if r not in best[2:]]


def made(kind, n, rng):
    step = {"even": lambda k: float(k), "falling": lambda k: (1 - 0.9 * k / n) * 0.99**k, "few": lambda k: float(rng.randint(0, n // 4)), "any": lambda k: rng.random() * n}[kind]
    at, rows = 0.0, []
    for k in range(n):
        at = at + step(k) if kind == "falling" else step(k)
        rows.append((k, rng.randint(0, 1) if kind != "falling" else k % 2, at))
    return rows


@pytest.mark.parametrize("kind", ["even", "falling", "few", "any"])
def test_settled_pairs_do_not_depend_on_ranges(kind):
    rng = random.Random(kind)
    for n, caliper in ((60, 1.0), (80, 3.0), (50, 1e9)):
        rows = made(kind, n, rng)
        want = [p for p in plain(rows, caliper) if p[2] > 0]
        matched = {k for p in plain(rows, caliper) if p[2] == 0 for k in p[:2]}
        rest = sorted((s, str(k), t, k) for k, t, s in rows if k not in matched)
        for _ in range(6):
            a, b = sorted(rng.sample(range(len(rest) + 1), 2)) if len(rest) > 2 else (0, len(rest))
            part = rest[a:b]
            below, above = rest[a - 1][0] if a else float("-inf"), rest[b][0] if b < len(rest) else float("inf")
            pairs, still = MT.settled_pairs([r[0] for r in part], [r[2] for r in part], [r[1] for r in part], caliper, below, above)
            got = {(part[i][3], part[j][3]) for i, j in pairs}
            assert got <= {p[:2] for p in want}
            # what is neither settled nor open stays unmatched
            closed = {r[3] for k, r in enumerate(part) if k not in still} - {k for p in got for k in p}
            assert not closed & {k for p in want for k in p[:2]}


@pytest.mark.parametrize("kind,range_rows", [("even", 16), ("falling", 25), ("few", 20), ("any", 30), ("any", 1000)])
def test_matching_like_a_plain_pass(spark, monkeypatch, kind, range_rows):
    monkeypatch.setattr(MT, "greedy_rounds", lambda rows, caliper, f=MT.greedy_rounds: f(rows, caliper, range_rows))
    rows = made(kind, 120, random.Random(7))
    df = spark.createDataFrame([*rows, (900, 1, None), (901, 0, float("nan")), (902, None, 1.0)], "k int, arm int, score double").repartition(7)
    got = MT.match_nearest(df, "k", "arm", "score", 2.0)
    assert sorted(map(tuple, got.collect())) == plain(rows, 2.0)


def test_evenly_spaced_rows_in_few_rounds(spark):
    df = spark.range(100_000).select("id", F.expr("cast(conv(substring(md5(cast(id as string)), 1, 1), 16, 10) as int) % 2 as t"), F.col("id").cast("double").alias("s"), F.col("id").cast("string").alias("name"))
    pairs, rounds = MT.greedy_rounds(df, 1.0, range_rows=4000)
    assert rounds <= 6
    used = pairs.select(F.explode(F.array("treated", "control")).alias("id"))
    assert used.count() == used.distinct().count()
    # no two neighbours of different arms are both left
    left = df.join(used, "id", "left_anti").select("id", "t")
    clash = left.alias("a").join(left.alias("b"), F.expr("b.id = a.id + 1 and a.t <> b.t"))
    assert clash.count() == 0


def test_one_score_for_most_rows(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("t"), F.when(F.col("id") < 15_000, 0.5).otherwise(F.col("id").cast("double")).alias("s"))
    pairs = MT.match_nearest(df, "id", "t", "s", 0.2)
    assert pairs.where("gap = 0").count() == 5000


def test_empty_and_one_armed(spark):
    kind = "k int, arm int, score double"
    for rows in ([], [(1, 1, 0.0)], [(1, 1, 0.0), (2, 1, 0.1)]):
        assert MT.match_nearest(spark.createDataFrame(rows, kind), "k", "arm", "score").count() == 0

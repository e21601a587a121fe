"""Importance resampling against a plain computation, with any head, and on the defined cases."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter

import pytest

from proseweave.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = [
    (1, "The Alpha beta, gamma delta. " * 6), (2, "alpha beta " * 15), (3, None), (4, ""), (5, "naïve Été ÉTÉ İstanbul x_y z9 " * 5), (5, "naïve Été ÉTÉ İstanbul x_y z9 " * 5),
    (6, "one two three"), (None, "alpha omega " * 12), (None, "alpha omega " * 12), (7, "word " * 70_000 + "x" * 300), (8, "!!! ??? " * 30), (9, "beta beta gamma " * 9), (10, "tail words of many kinds " * 5),
]
TARGET = [(1, "alpha omega alpha beta"), (2, None), (3, "")]


def plain(docs, target, longest, buckets, least, percent, seed):
    def features(text):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda rows: Counter(bucket(f) for _, t in rows for f in features(t)[1])
    s, t = count(docs), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (n_s + buckets)) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        n, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("longest,entries,percent", [(1, rs.HEAD, 100), (1, 0, 60), (2, rs.HEAD, 50), (2, 3, 100), (3, 40, 30)])
def test_like_a_plain_computation_with_any_head(spark, longest, entries, percent):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as rank", "2 as _n", "3 as _part")
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    model = rs.train(docs, target, longest=longest, buckets=97, entries=entries)
    got = rs.resample(docs, model, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain(DOCS, TARGET, longest, 97, rs.LEAST_WORDS, percent, rs.SEED)


def test_states_carry_on_to_longer_runs():
    states = {w: zlib.crc32(w) for w in (b"a", "é".encode())}
    table = rs.Buckets(states, {b"a b": zlib.crc32(b"a b") % 1000}, 1000)
    for feature in (b"a", b"zz", b"a b", b"a zz", "é a b".encode(), b"zz a"):
        assert table[feature] == zlib.crc32(feature) % 1000
    assert len(table) == 3  # nothing of the tail is kept
    again = pickle.loads(pickle.dumps(table))
    assert dict(again) == dict(table) and again[b"a zz"] == zlib.crc32(b"a zz") % 1000


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert rs.resample(none, rs.train(none, docs)).count() == 0
    assert rs.resample(docs, rs.train(docs, none)).count() == len(DOCS)
    short = spark.createDataFrame([(1, "too short")], "doc_id long, text string")
    assert [r["rank"] for r in rs.resample(short, rs.train(short, none)).collect()] == [None]


def test_the_sample_leans_to_the_target(spark):
    docs = [(k, ("alpha " if k % 2 else "omega ") * 30) for k in range(400)]
    model = rs.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "alpha " * 50)], "item_id long, text string"))
    drawn = [r.doc_id for r in rs.resample(spark.createDataFrame(docs, "doc_id long, text string"), model).where("rank is not null").collect()]
    assert len(drawn) == 40 and sum(k % 2 for k in drawn) >= 39

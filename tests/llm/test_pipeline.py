"""The pipeline: every stage against a plain computation on the same input, and the whole run on the smallest tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from proseweave.llm import mixing, nearcopies, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_follow_each_other(spark, docs):
    kept = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= kept.count()
        kept = out
    last = P.STAGES[-1][1](spark, kept, SF)
    assert set(docs.columns) <= set(last.columns)
    want = {r.doc_id for r in mixing.mix(kept).where("_kept").collect()}
    assert {r.doc_id for r in last.collect()} == want


def test_quality_stage(spark, docs):
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    want = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in P.quality_stage(spark, docs, SF).collect()} == want


def test_decontamination_stage(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in wins}
    hit = lambda t: any(tuple(w[k : k + n]) in wins for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))
    want = {r.doc_id for r in docs.collect() if not hit(r.text)}
    assert {r.doc_id for r in P.decontamination_stage(spark, docs, SF).collect()} == want


def test_pii_stage(spark, docs):
    field = pii.train(pii.labelled_table(spark))
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in P.pii_stage(spark, docs, SF).collect():
        assert not pii.base_spans(r.text or "") and r.n_chars == len(r.text or "")
        assert bool(pii.base_spans(before[r.doc_id] or "")) <= (r.text != before[r.doc_id])
    assert field is not None


def test_run_on_empty_and_null_rows(spark, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, 0), (2, "", "en", "s", 0), (3, "a b", None, "s", 3), (3, "a b", None, "s", 3)], docs.schema)
    for rows in (odd, odd.limit(0)):
        kept = rows
        for _, stage in P.STAGES:
            kept = stage(spark, kept, SF)
        kept.collect()


def test_run(spark, docs):
    out = P.run(spark, SF)
    assert 0 < out.count() < docs.count()


def test_near_copy_stage_against_brute_force_jaccard(spark, docs):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for size in (3, 5, 12, 40, 90, 200, 200):
        base = passage[: size // 3] + [word() for _ in range(size)]
        for edits in (0, 1, 1, 2, 3, 4, 5, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(120)]  # each near the last one, the ends far apart
    for _ in range(14):
        texts.append(" ".join(chain))
        chain = chain[9:] + [word() for _ in range(9)]
    texts += [f"{' '.join(passage)} {word()}" for _ in range(20)] + [t.upper().replace(" ", " \n") for t in texts[:4]] + [None, "", " "]
    rows = [(i, t) for i, t in zip(rng.sample(range(10**6), len(texts)), texts)] + [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    low, changed = {i: i for i, _ in rows}, True
    near = [(rows[x][0], rows[y][0]) for x in range(len(rows)) for y in range(x) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]
    while changed:
        changed = False
        for a, b in near:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    stage = dict(P.STAGES)["near_duplicates"]
    kept = [r.doc_id for r in stage(spark, frame, SF).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {i for i, c in low.items() if i == c}


def test_pairs_of_sets_like_plain_counting():
    rng = random.Random(8)
    for n in (1, 2, 9, 40, 63):
        base = [rng.randrange(1000) for _ in range(60)]
        sets = [np.unique([rng.randrange(10**6) if rng.random() < 0.1 else h for h in base[: rng.randint(1, 60)]]).astype(np.int64) for _ in range(n)]
        a, b = nearcopies.similar_pairs(sets)
        want = {(i, j) for j in range(n) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_a_group_of_loose_copies_makes_no_rows_of_pairs(spark, docs, monkeypatch):
    rng = random.Random(9)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for _ in range(300):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], docs.schema)
    seen, plain = [], nearcopies._links
    monkeypatch.setattr(nearcopies, "_links", lambda meetings, held: (seen.append(meetings.count()), plain(meetings, held))[1])
    kept = {r.doc_id for r in nearcopies.keep_one(frame).collect()}
    assert sum(seen) < 300 * 20  # 44,850 pairs
    a, b = nearcopies.similar_pairs([nearcopies.shingles(t) for t in texts])
    low = list(range(300))
    for _ in range(300):
        for i, j in zip(a, b):
            low[i] = low[j] = min(low[i], low[j])
    assert kept == {i for i in range(300) if low[i] == i}


def test_extra_columns_keep_their_names_and_values(spark, docs):
    names = ("topic", "n_tokens", "probability", "_tokens", "_node", "_source", "_kept", "_digest", "component", "id", "held")
    frame = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in P.STAGES:
        frame = stage(spark, frame, SF)
        rows = frame.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names), name
    assert {"topic_", "n_tokens_", "probability_"} <= set(frame.columns)


def test_null_ids_are_decided_by_their_component(spark, docs):
    rows = [(4, "a b c d e f"), (None, "a b c d e f"), (None, "u v w x y z"), (None, "u v w x y z"), (None, "k l m n o p")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    kept = dict(P.STAGES)["near_duplicates"](spark, frame, SF).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == [("a b c d e f", 4), ("k l m n o p", None), ("u v w x y z", None)]


def test_texts_that_meet_no_other_stay_where_they_are(spark, monkeypatch):
    texts = spark.range(3000).select((F.col("id") * (1 << 33) + 5).alias("node"), F.lit("t").alias("text"), F.lit("d").alias("digest"))
    meetings = texts.where("node % 7 = 3").select(F.lit(1).alias("low"), F.lit(2).alias("high"), "node")
    met = {r.node for r in meetings.collect()}
    held = [r.node for r in nearcopies._wanted(texts, meetings.unionByName(meetings)).collect()]
    assert len(held) == len(set(held)) <= len(met) + 3 and met <= set(held)
    monkeypatch.setattr(nearcopies, "MARKS", 256)  # too few marks leave more in, never one out
    assert met <= {r.node for r in nearcopies._wanted(texts, meetings).collect()}
    assert nearcopies._wanted(texts, meetings.limit(0)).count() == 0

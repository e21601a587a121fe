"""Words meet their vectors in blocks: the same results as by a join of every word, and a vector once for a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseweave.operators import distances as D
from proseweave.operators import encode as E

RNG = np.random.default_rng(11)
WORDS = [f"w{k}" for k in range(30)]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(s, p, [WORDS[k] for k in RNG.zipf(1.5, 12) if k < 30]) for s in range(6) for p in range(8)]
    rows += [(7, 0, []), (7, 1, None), (7, 2, ["w1"]), (7, 2, ["w2", "zz"]), (None, 0, ["w1"]), (8, 0, ["zz"]), (8, 1, ["w3"])]
    return spark.createDataFrame(rows, "story_id long, pos long, tokens array<string>")


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(w, RNG.normal(size=4).tolist()) for w in WORDS] + [("gone", None)], "token string, vec array<double>")


def test_means(spark, tokens, vocabulary, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_TOKENS", 20)
    got = {}
    for r in E.word_means(tokens, vocabulary, 4).collect():
        got.setdefault((r.story_id, r.pos), []).append(r.vec)
    vec, texts, copies = {r.token: r.vec for r in vocabulary.collect()}, {}, {}
    for r in tokens.collect():
        texts.setdefault((r.story_id, r.pos), []).extend(r.tokens or [])
        copies[r.story_id, r.pos] = copies.get((r.story_id, r.pos), 0) + 1
    for key, found in got.items():
        known = [vec[t] for t in texts[key] if t in vec and key[0] is not None]
        assert len(found) == copies[key] and np.allclose(found, np.mean(known, axis=0) if known else np.zeros(4)), key
    assert got.keys() == texts.keys()


@pytest.mark.parametrize("metric", ["wmd", "wmd_relaxed"])
def test_consecutive_words_like_bags_with_vectors(spark, tokens, vocabulary, metric, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_TOKENS", 20)
    want = {(r.story_id, r.step): r.d for r in D.consecutive(E.word_bags(tokens, vocabulary), metric).collect()}
    got = {(r.story_id, r.step): r.d for r in D.consecutive_words(E.token_bags(tokens), vocabulary, metric).collect()}
    assert got.keys() == want.keys() and len(got) == 6 * 7 + 3
    for key, d in want.items():
        assert got[key] is None if d is None else got[key] == pytest.approx(d, abs=1e-7), key


def test_a_vector_travels_once_for_a_block(spark, vocabulary):
    rows = spark.createDataFrame([(s, 0, ["w1"] * 50) for s in range(200)], "story_id long, pos long, tokens array<string>")
    schema = "story_id long, held long"
    seen = lambda table, words: table.select(["story_id"]).append_column("held", [[len(words.matrix)] * len(table)])
    found = E.by_blocks(rows, F.col("tokens"), vocabulary, seen, schema).collect()
    assert len(found) == 200 and {r.held for r in found} == {1}


def test_a_token_with_two_vectors_counts_with_both(spark, vocabulary):
    few = spark.createDataFrame([(1, 0, ["w1", "w2", "w1"]), (1, 1, ["w2", "w3"])], "story_id long, pos long, tokens array<string>")
    twice = vocabulary.where("vec is not null").unionByName(vocabulary.where("token = 'w1'").withColumn("vec", F.transform("vec", lambda x: -2 * x)))
    vec = {r.token: np.array(r.vec) for r in vocabulary.collect() if r.vec}
    got = {r.pos: r.vec for r in E.word_means(few, twice, 4).collect()}
    assert np.allclose(got[0], (2 * vec["w1"] - 4 * vec["w1"] + vec["w2"]) / 5) and np.allclose(got[1], (vec["w2"] + vec["w3"]) / 2)
    for metric in ("wmd", "wmd_relaxed"):
        own = D.consecutive_words(E.token_bags(few), twice, metric).first().d
        a, b = (np.array([vec["w1"], -2 * vec["w1"], vec["w2"]]), np.array([2.0, 2, 1])), (np.array([vec["w2"], vec["w3"]]), np.array([1.0, 1]))
        assert own == pytest.approx(D._mover(a, b, metric == "wmd"), abs=1e-7)


def test_prices_are_mended_where_the_tree_changed():
    from proseweave.functions import kernels as K

    looked = []

    class Costs(list):
        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k)

    words = RNG.normal(size=(160, 6))
    wa, wb = (RNG.integers(1, 9, 80).astype(float) for _ in "ab")
    costs = K.word_costs(words[:80], words[80:])

    class Matrix(np.ndarray):
        def tolist(self):
            return Costs(np.asarray(self).tolist())

    got = K.exact_transport(costs.view(Matrix), wa, wb)
    assert got == pytest.approx(K.exact_transport(costs, wa, wb))
    # a price for every node once, then parts of the tree: far from all 160 nodes for each of the pivots
    many = len(looked) / 160
    assert 1 <= many < 60


@pytest.mark.parametrize("metric", ["wmd", "wmd_relaxed"])
def test_all_pairs_of_bags_without_vectors(spark, tokens, vocabulary, metric, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_TOKENS", 20)
    rows = tokens.where("story_id is not null")
    want = {r.story_id: r for r in D.pair_summary(E.word_bags(rows, vocabulary), metric, block=3).collect()}
    got = {r.story_id: r for r in D.pair_summary(E.token_bags(rows), metric, block=3, vocabulary=vocabulary).collect()}
    plain = {r.story_id: r for r in D.pair_summary(E.word_bags(rows, vocabulary), metric).collect()}
    assert got.keys() == want.keys() == plain.keys() and len(got) == 8
    for story, r in plain.items():
        for other in (got[story], want[story]):
            assert all(other[c] is None if v is None else other[c] == pytest.approx(v, abs=1e-7) for c, v in r.asDict().items()), (story, r, other)

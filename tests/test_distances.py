import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseweave.functions import kernels as K
from proseweave.operators import density as N
from proseweave.operators import distances as D
from proseweave.operators import ordered as O

RNG = np.random.default_rng(7)


def table(spark, stories):
    rows = [(s, i, v.tolist()) for s, m in stories.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "story_id long, pos long, vec array<double>").repartition(4)


def pairs(m):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return (1 - u @ u.T)[np.triu_indices(len(m), 1)]


STORIES = {1: RNG.normal(size=(5, 4)), 2: RNG.normal(size=(1, 4)), 3: RNG.normal(size=(40, 4)), 4: np.repeat(RNG.normal(size=(1, 4)), 9, axis=0)}


@pytest.mark.parametrize("block", [3, 7, 64])
def test_pair_summary_for_any_block(spark, block):
    got = {r["story_id"]: r for r in D.pair_summary(table(spark, STORIES), block=block).collect()}
    for s, m in STORIES.items():
        d = pairs(m) if len(m) > 1 else np.array([1.0])
        r = got[s]
        assert r["n_pairs"] == len(d)
        for name, want in (("mean", d.mean()), ("median", np.median(d)), ("std", d.std()), ("min", d.min()), ("max", d.max())):
            assert r[name] == pytest.approx(want, abs=2e-8 if name == "std" else 1e-9), (s, name, block)


def test_window_and_moments(spark):
    t = table(spark, STORIES)
    got = {r["story_id"] for r in D.pair_summary(t, max_rows=9).collect()}
    assert got == {1, 2, 4}
    lin = {r["story_id"]: r["mean"] for r in D.pair_moments(t).collect()}
    for s, m in STORIES.items():
        assert lin[s] == pytest.approx(pairs(m).mean() if len(m) > 1 else 1.0, abs=1e-9)


def test_zero_vector_gives_null(spark):
    t = table(spark, {1: np.array([[1.0, 0], [0, 0], [1, 1]])})
    assert D.pair_summary(t).first()["mean"] is None
    assert [r["d"] for r in D.consecutive(t).collect()] == [None, None]


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_next_row_and_running_sum_with_gaps(spark, block):
    rows = [(k, p, float(p)) for k in (1, 2) for p in (0, 1, 4, 9, 10, 23)]
    df = spark.createDataFrame(rows, "k int, p long, v double")
    nxt = {(r["k"], r["p"]): r["n"] for r in O.next_row(df, "k", "p", {"p": "n"}, block).collect()}
    assert [nxt[1, p] for p in (0, 1, 4, 9, 10, 23)] == [1, 4, 9, 10, 23, None]
    run = {(r["k"], r["p"]): r["s"] for r in O.running_sum(df, "k", "p", "v", "s", block).collect()}
    assert [run[2, p] for p in (0, 1, 4, 9, 10, 23)] == [0, 1, 5, 14, 24, 47]


def test_narrative_speed_equals_gradient(spark):
    got = {r["story_id"]: r["speed"] for r in N.narrative_speed(table(spark, STORIES)).collect()}
    for s, m in STORIES.items():
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        c = np.cumsum(1 - (u[:-1] * u[1:]).sum(1))
        want = 0 if len(c) <= 2 else 2 * np.abs(np.gradient(c)).sum() / len(c)
        assert got[s] == pytest.approx(want, abs=1e-9)


def test_silhouette_in_tiles(spark):
    m, lab = RNG.normal(size=(30, 3)), RNG.integers(0, 3, 30)
    rows = [(1, i, m[i].tolist(), int(lab[i])) for i in range(30)]
    t = spark.createDataFrame(rows, "story_id long, pos long, vec array<double>, label int")
    d = np.linalg.norm(m[:, None] - m[None], axis=2)
    s = []
    for i in range(30):
        own = (lab == lab[i]) & (np.arange(30) != i)
        a, b = d[i][own].mean(), min(d[i][lab == k].mean() for k in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    for block in (4, 64):
        assert N.silhouette(t, block=block).first()["silhouette"] == pytest.approx(np.mean(s), abs=1e-9)


def test_paraphrase_vs_rest_and_pairs(spark):
    toks = [["a", "b"], ["a", "b"], ["a", "c"], ["d"], ["a", "d"]]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(toks)], "story_id long, pos long, tokens array<string>")
    idx = spark.createDataFrame([(1, 0, 4)], "story_id long, src int, dst int")
    J = K.multiset_jaccard
    rest = np.mean([J(toks[i], toks[j]) for i, j in ((1, 2), (1, 3), (2, 3))])
    assert D.paraphrase_vs_rest(t, idx, "jaccard").first()["para_vs_others"] == pytest.approx(J(toks[0], toks[4]) - rest)
    assert D.paraphrase_vs_rest(t, idx, "jaccard", compat=True).first()["para_vs_others"] == pytest.approx(1 - rest)
    missing = spark.createDataFrame([(1, 0, 40), (9, 0, 1)], "story_id long, src int, dst int")
    assert {r["para_vs_others"] for r in D.paraphrase_vs_rest(t, missing, "jaccard").collect()} == {0.0}
    with pytest.raises(ValueError):
        D.consecutive(t, "nonsense")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10_000))
def test_transport_bounds_and_symmetry(m, n, seed):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(m, 3)), r.normal(size=(n, 3))
    wa, wb = r.integers(1, 4, m).astype(float), r.integers(1, 4, n).astype(float)
    c = K.word_costs(a, b)
    exact = K.exact_transport(c, wa, wb)
    assert exact == pytest.approx(K.exact_transport(c.T, wb, wa), abs=1e-9)
    assert K.relaxed_transport(c, wa / wa.sum(), wb / wb.sum()) <= exact + 1e-9
    assert exact <= c.max() + 1e-9


def test_transport_equals_assignment():
    from itertools import permutations

    for seed in range(40):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 6))
        c = r.random((n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n))) / n
        assert K.exact_transport(c, np.ones(n), np.ones(n)) == pytest.approx(best)


def test_wide_features_names(spark):
    w = D.feature_table({"w2v": table(spark, STORIES)}, max_rows=19)
    assert "w2v_all_cosine_sentences_similarity_median" in w.columns
    assert "w2v_consecutive_cosine_sentences_similarity_std" in w.columns
    lone = w.where(F.col("story_id") == 2).first()
    assert lone["w2v_all_cosine_sentences_similarity_mean"] == 1.0 and lone["w2v_consecutive_cosine_sentences_similarity_std"] == 0.0


def test_cells_of_long_stories_leave_in_bounded_batches(monkeypatch):
    """All tiles of an Arrow batch together, as lists of rows, once filled an executor."""
    monkeypatch.setattr(D, "CELL_ROWS", 500)
    want, tiles = [{"lo": 0.0, "width": 2.0, "bins": 1 << 40}, {"lo": 0.5, "width": 0.25, "bins": 4}], [RNG.uniform(0, 1.9, 400) for _ in range(30)]
    looked = []
    made = D._cell_batches(pa.array(range(30)), [want] * 30, (looked.append(0) or d for d in tiles), "story_id")
    first = next(made)
    assert len(looked) == 2 and first.num_rows <= 500 + 404  # two tiles were enough for a batch
    rows = pa.Table.from_batches([first, *made]).to_pandas()
    assert len(rows) > 12000
    for k, d in enumerate(tiles):
        own = rows[(rows.story_id == k) & (rows["at"] == 0)]
        assert own.n.sum() == 400 and sorted(own.low) == sorted(d)
        coarse = rows[(rows.story_id == k) & (rows["at"] == 1)]
        assert len(coarse) == 4 and coarse.n.sum() == ((d >= 0.5) & (d < 0.75)).sum()


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
def test_median_of_a_long_story_in_two_rounds(spark, monkeypatch, metric):
    seen = []
    monkeypatch.setattr(D, "cut_lineage", lambda df, plain=D.cut_lineage: (seen.append(df.columns), plain(df))[1])
    if metric == "cosine":
        rows = RNG.normal(size=(120, 4))
        long, want = table(spark, {1: rows, 2: rows[:9]}), np.median(pairs(rows))
    else:
        tokens = [[f"w{k}" for k in RNG.integers(0, 30, 12)] for _ in range(50)]
        long = spark.createDataFrame([(1, k, t) for k, t in enumerate(tokens)], "story_id long, pos long, tokens array<string>")
        want = np.median([K.multiset_jaccard(a, b) for k, a in enumerate(tokens) for b in tokens[:k]])
    got = {r.story_id: r for r in D.pair_summary(long, metric, block=20).collect()}
    assert got[1]["median"] == pytest.approx(want, abs=1e-9)
    assert 1 <= sum("acc" in c for c in seen) <= 2  # the distances of a cell are told apart at once

import numpy as np
import pytest

from proseweave.functions import solvers as S
from proseweave.operators import density as N

RNG = np.random.default_rng(3)


def test_components_match_svd():
    e = RNG.normal(size=(7, 20))
    x = e.T - e.T.mean(axis=0)
    v = np.linalg.svd(x, compute_uv=False) ** 2
    assert np.allclose(S.component_shares(e), (v / v.sum())[:6])
    un, prop = S.pca_scores(e)
    assert un == pytest.approx(1 - (v / v.sum())[:2].sum()) and 0 < prop <= 1


def test_lasso_optimality():
    x, w = RNG.normal(size=(50, 6)), np.array([2.0, 0, 0, -1, 0, 0])
    y = x @ w + 0.1 * RNG.normal(size=50)
    xc, yc = x - x.mean(0), y - y.mean()
    b = S.shrunk_regression(xc.T @ xc, xc.T @ yc, float(yc @ yc), 50, 0.3, tol=1e-12)
    grad = xc.T @ (yc - xc @ b) / 50
    assert np.all(np.abs(grad) <= 0.3 + 1e-6)
    assert np.allclose(grad[b != 0], 0.3 * np.sign(b[b != 0]), atol=1e-5)


def test_mean_shift_and_density_clusters():
    e = np.vstack([RNG.normal(0, 0.05, (6, 3)), RNG.normal(5, 0.05, (6, 3))])
    for labels in (S.mean_shift(e), S.density_clusters(e)):
        assert len(set(labels[:6]) & set(labels[6:]) - {-1}) == 0
    # the bandwidth is a near-neighbour distance: repeated sentences collapse, spread ones do not
    assert len(set(S.mean_shift(np.repeat(e[[0, 6]], 6, axis=0)))) == 2
    assert 2 <= len(set(S.mean_shift(e))) < 12
    # worked by hand: two tight pairs survive the split at 9.9, the far point leaves the root as noise
    a, b, c, d, far = S.density_clusters(np.array([[0.0], [0.1], [10.0], [10.1], [30.0]]))
    assert a == b != c == d and far == -1 and -1 not in (a, c)
    assert len(set(S.mean_shift(RNG.normal(size=(5, 3))))) == 5  # bandwidth 0 for few sentences
    assert S.density_clusters(np.zeros((1, 2))).tolist() == [-1]
    assert len(S.density_clusters(np.zeros((4, 2)))) == 4  # identical sentences


def test_elimination_bounds():
    e = RNG.normal(size=(6, 30))
    assert 1 / 6 <= S.elimination_share(e, e.mean(0)) <= 4 / 6
    assert S.elimination_share(e[:2], e[:2].mean(0)) == 0.0


def test_unknown_methods(spark):
    df = spark.createDataFrame([(1, 0, [1.0])], "story_id long, pos long, vec array<double>")
    with pytest.raises(ValueError):
        N.cluster_labels(N.gather(df), "KMeans")
    with pytest.raises(ValueError):
        N.matrix_scores(N.gather(df), "Huber")


def test_repetition_orders_the_scores(spark):
    """Six short stories from constant repetition to none: more repetition, less movement."""
    base = RNG.normal(size=(7, 16))
    near = lambda v: v + 0.05 * RNG.normal(size=16)
    stories = {
        0: [near(base[0]) for _ in range(7)],
        1: [near(base[i // 4]) for i in range(7)],
        2: [base[0], near(base[0]), *base[1:6]],
        3: list(base),
    }
    rows = [(s, i, np.asarray(v).tolist()) for s, vs in stories.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "story_id long, pos long, vec array<double>")
    t, names = N.density_table(df)
    got = {r["story_id"]: r for r in t.collect()}
    speed = [got[s]["narrative_speed_score"] for s in range(4)]
    assert speed[0] < speed[1] < min(speed[2:])  # one repetition at the start hardly moves the gradient
    assert got[0]["reduction_score_PCA_explained_variance"] < got[3]["reduction_score_PCA_explained_variance"]
    alt, alt_names = N.density_table(df, alternative=True)
    assert "trajectory_score" in alt_names and "reduction_score_RFE_Lasso" in alt_names and len(names) == 11


def test_longer_stories_keep_a_row(spark):
    rows = [(s, i, RNG.normal(size=8).tolist()) for s, n in ((1, 7), (2, 25)) for i in range(n)]
    t, names = N.density_table(spark.createDataFrame(rows, "story_id long, pos long, vec array<double>"))
    got = {r["story_id"]: r for r in t.collect()}
    assert got[1]["num_sentences"] == 7 and all(got[1][c] is not None for c in names)
    assert got[2]["num_sentences"] == 25 and got[2]["narrative_speed_score"] > 0 and got[2]["reduction_score_Lasso"] is None

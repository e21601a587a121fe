import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proseweave.functions import tails as T
from proseweave.operators import cca, evaluation, feature_groups, matching, ordered, regression, stats

RNG = np.random.default_rng(5)


def frame(spark, n=300, ties=True):
    x = RNG.normal(size=n)
    d = {"x": np.round(x, 1) if ties else x, "y": np.round(0.5 * x + RNG.normal(size=n), 1), "g": RNG.integers(0, 2, n), "id": np.arange(n)}
    return pd.DataFrame(d), spark.createDataFrame(pd.DataFrame(d)).repartition(5)


def test_tails():
    assert T.norm_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert T.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert T.f_tail(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert T.f_tail(3.0, 2, 57) == pytest.approx((1 + 2 * 3.0 / 57) ** (-57 / 2))
    assert T.t_quantile(0.025, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert T.power_two_groups(50, 50, 0.5, 0.05) == pytest.approx(0.6968934, abs=1e-3)
    assert T.power_two_groups(20, 20, 0.0, 0.05) == pytest.approx(0.05, abs=1e-3)
    assert T.power_groups(0.0, 3, 10) == pytest.approx(0.05, abs=1e-6)
    assert T.bayes_factor_correlation(0.0, 20) < 1 < T.bayes_factor_correlation(0.8, 20)
    assert T.bayes_factor_t(0.0, 30, 30) < 1 < T.bayes_factor_t(5.0, 30, 30)


def test_ranks_and_quantiles(spark):
    pdf, df = frame(spark)
    long = ordered.melt(df, [], ["x", "y"])
    got = {(r["feature"], r["value"]): r for r in ordered.rank_table(long).collect()}
    for c in "xy":
        for v, rank in zip(pdf[c], pdf[c].rank()):
            assert got[c, v]["avg_rank"] == rank
    q = {r["feature"]: r for r in ordered.exact_quantiles(long, {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for c in "xy":
        assert [q[c][k] for k in "abc"] == pytest.approx(list(np.quantile(pdf[c], [0.25, 0.5, 0.9])))


def test_text_ranks(spark):
    words = ["été", "eta", "Zoo", "a", "ab", "abcdefgh", "abcdefgi", "", "zoo"] + [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "w string")
    got = {r["w"]: r["rank"] for r in ordered.text_ranks(df, "w").collect()}
    want = {w: i for i, w in enumerate(sorted(set(words), key=lambda w: w.encode()))}
    assert got == want


def test_kendall_by_brute_force(spark):
    for ties in (True, False):
        pdf, df = frame(spark, 150, ties)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(len(x)), 2))
        pair = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
        n0 = len(x) * (len(x) - 1) / 2
        want = s / math.sqrt((n0 - pair(x)) * (n0 - pair(y)))
        assert stats.kendall_pairs(df, [("x", "y")]).first()["r"] == pytest.approx(want)


def test_skipped_correlation_ignores_outliers(spark):
    pdf, df = frame(spark, 200)
    bad = spark.createDataFrame([(50.0, -50.0, 0, 1000 + i) for i in range(5)], "x double, y double, g long, id long")
    dirty = df.unionByName(bad)
    flagged = stats.outlier_flags(dirty, "x", "y").where("id >= 1000")
    assert flagged.where("outlier").count() == 5
    assert stats.skipped_pairs(dirty, [("x", "y")]).first()["r"] > 0.2


def test_tables_and_errors(spark):
    pdf, df = frame(spark)
    df = df.withColumn("flat", F.lit(1.0))
    t = {r["y"]: r for r in stats.correlation_table(df, ["x"], ["y", "flat"], None).collect()}
    assert t["flat"]["r"] is None and t["flat"]["error"] and t["y"]["p_val"] < 0.001
    assert [r["y"] for r in stats.correlation_table(df, ["x"], ["y", "flat"], 0.01).collect()] == ["y"]
    with pytest.raises(ValueError):
        stats.correlate(df, [("x", "y")], "cosine")
    a = stats.anova_table(df, ["g"], ["x", "flat"], None)
    assert {r["y"]: r["p_unc"] for r in a.collect()}["flat"] == 1.0
    p = [0.01, 0.04, 0.03, 0.5, 0.02]
    adj = stats.adjust_bh(spark.createDataFrame([(v,) for v in p], "p_val double")).orderBy("p_val")
    assert [r["adjusted_p_value"] for r in adj.collect()] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.5])


def test_icc_identity(spark):
    df = spark.createDataFrame([(float(i), float(i), float(i) + 1) for i in range(10)], "a double, b double, c double")
    r = {x["feature"]: x for x in stats.icc_table(df, {"same": ("a", "b"), "shift": ("a", "c")}).collect()}
    assert r["same"]["icc"] == pytest.approx(1.0) and r["shift"]["icc"] < 1


def test_ols_against_lstsq(spark):
    pdf, df = frame(spark)
    out = regression.hierarchical_ols(df, "y", ["x"], ["g"])
    X = np.column_stack([np.ones(len(pdf)), pdf["g"], pdf["x"]])
    b, *_ = np.linalg.lstsq(X, pdf["y"], rcond=None)
    got = {r["term"]: r["coef"] for r in out["coefficients"].collect()}
    assert [got[k] for k in ("const", "g", "x")] == pytest.approx(list(b))
    res = [r["semantic_residual"] for r in out["residuals"].orderBy("id").collect()]
    assert res == pytest.approx(list(pdf["y"] - X @ b))
    w = regression.marginal_r2(df, "y", ["x", "g"], weighted=True).collect()
    assert sum(r["contribution"] for r in w) == pytest.approx(w[0]["total_R2"])


def test_matching_is_one_to_one(spark):
    n = 200
    rows = [(i, int(i % 3 == 0), round(float(v), 2)) for i, v in enumerate(RNG.normal(size=n))] + [(1000 + i, i % 2, 9.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t int, s double")
    m = matching.match_nearest(df, "id", "t", "s", 0.05).collect()
    score = {r[0]: r[2] for r in rows}
    arm = {r[0]: r[1] for r in rows}
    assert len({r["treated"] for r in m}) == len(m) == len({r["control"] for r in m})
    assert all(arm[r["treated"]] == 1 and arm[r["control"]] == 0 and abs(score[r["treated"]] - score[r["control"]]) <= 0.05 for r in m)
    assert sum(r["treated"] >= 1000 for r in m) == 20  # equal scores are paired off completely
    used = {x for r in m for x in (r["treated"], r["control"])}
    left1 = [score[i] for i in arm if arm[i] == 1 and i not in used]
    left0 = [score[i] for i in arm if arm[i] == 0 and i not in used]
    assert not any(abs(a - b) <= 0.05 for a in left1 for b in left0)  # nothing within the caliper is left


def test_split_and_undersample(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("g"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    s = evaluation.group_split(df, "g")
    assert s.where("is_test").select("g").distinct().count() == 2
    u = evaluation.undersample(df, "y", "id").groupBy("y").count().collect()
    assert {r["count"] for r in u} == {143}


def test_cca_finds_the_shared_axis(spark):
    n = 400
    z = RNG.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": z + 0.1 * RNG.normal(size=n), "b": RNG.normal(size=n), "c": RNG.normal(size=n), "p": z + 0.1 * RNG.normal(size=n), "q": RNG.normal(size=n)})
    df = spark.createDataFrame(pdf)
    out = cca.nested_search(df, ["a", "b", "c"], ["p", "q"], "id", {"alpha": [0.01, 0.1], "l1_ratio": [1], "latent_dimensions": [1]})
    assert out["score"] > 0.9 and abs(out["u"][0, 0]) > 10 * np.abs(out["u"][1:, 0]).max()
    v = cca.variates(df, ["a", "b", "c"], ["p", "q"], out["u"], out["v"])
    assert cca.permutation_test(v, "id", 1, 30).first()["p"] == 0.0


def test_feature_groups(spark):
    n = 300
    z = RNG.random(size=n)
    pdf = pd.DataFrame({"a": z, "b": z + 0.01 * RNG.random(n), "c": RNG.random(n)})
    df = spark.createDataFrame(pdf)
    got = {r["feature"]: r["cluster"] for r in feature_groups.by_clustering(df, ["a", "b", "c"], 0.5, "spearman").collect()}
    assert got["a"] == got["b"] != got["c"]
    pc = {(r["component"], r["feature"]): r["loading"] for r in feature_groups.by_pca(df, ["a", "b", "c"], 2).collect()}
    vec = np.linalg.eigh(np.cov(pdf.T.to_numpy()))[1][:, -1]
    assert abs(pc["PC1", "a"]) == pytest.approx(abs(vec[0]))
    h = feature_groups.by_nmf(df, ["a", "b", "c"], 2, steps=20)
    assert h.where("loading < 0").count() == 0
    ic = feature_groups.by_ica(df, ["a", "c"], 2)
    assert ic.count() == 4
    with pytest.raises(ValueError):
        feature_groups.by_nmf(df.withColumn("a", -F.col("a")), ["a", "b"], 1)


def test_ranksum_of_counts_beyond_a_long(spark):
    # n1 * n0 * (N + 1) of ten million rows is beyond 2^63
    n = 10_000_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), (F.col("id") % 5).cast("double").alias("v"))
    row = stats.ranksum_table(df, ["g"], ["v"], None).first()
    counts = np.full(5, n // 5)
    ranks = np.cumsum(counts) - counts + (counts + 1) / 2
    r1 = float((ranks * n / 10).sum())  # half of every value's rows are of group 1
    want = (r1 - n / 2 * (n + 1) / 2) / math.sqrt(n / 2 * (n / 2) * (n + 1) / 12)
    assert row.stats == pytest.approx(want, abs=1e-6) and row.pval == pytest.approx(T.norm_two_sided(want), abs=1e-6)


def test_ranks_of_few_values_come_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW_RANKS", 5)
    pdf, _ = frame(spark, 400)
    pdf["h"] = np.where(pdf["x"] > 0.5, 7.0, pdf["y"])  # one value holds much of a column of many
    rows = [(None if k % 50 == 0 else r.x, r.y, float(r.g), r.h) for k, r in enumerate(pdf.itertuples())]
    df = spark.createDataFrame(rows, "x double, y double, g double, h double").repartition(5)
    got = ordered.with_ranks(df, {c: f"r_{c}" for c in "xygh"})
    assert got.columns == ["x", "y", "g", "h", "r_x", "r_y", "r_g", "r_h"]
    found = got.toPandas()
    for c in "xygh":
        assert np.allclose(found[f"r_{c}"], found[c].rank(), equal_nan=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ordered.with_ranks(df.select("g"), {"g": "r"})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan

"""Registered queries: statistical tables, scaling, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regression as G
from ..operators import stats as ST
from ..operators import tables as TB
from ..operators.ordered import melt, rank_table
from ..operators.syntax import zscores
from . import views as V

c = F.col
FEATURES = V.FEATURES


def rnd(df, keys, names, k=6):
    return df.select(*keys, *[F.round(c(n), k).alias(n) for n in names])


def average_ranks(spark, d):
    l = V.spread_features(spark, d)
    return rank_table(melt(l, [], ["l_quantity", "l_discount", "l_extendedprice"])).select("feature", "value", "n", "before", "total", "avg_rank")


def pearson_table(spark, d):
    return rnd(ST.correlate(V.features(spark, d), [("is_r", f) for f in FEATURES]), ["x", "y", "n"], ["r"])


def spearman_table(spark, d):
    return rnd(ST.correlate(V.spread_features(spark, d), [("is_r", f) for f in FEATURES] + [("l_quantity", "l_extendedprice")], "spearman"), ["x", "y", "n"], ["r"])


def spearman_with_gaps(spark, d):
    """Missing values: ranks are taken over the rows complete for the pair."""
    l = V.features(spark, d).select(
        F.when(c("l_discount") > 0.01, c("l_quantity")).alias("q"), F.when(c("l_tax") > 0.01, c("l_extendedprice")).alias("p"), "l_tax"
    )
    return rnd(ST.correlate(l, [("q", "p"), ("q", "l_tax")], "spearman"), ["x", "y", "n"], ["r"])


def kendall_table(spark, d):
    return rnd(ST.correlate(V.spread_features(spark, d), [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax")], "kendall"), ["x", "y", "n"], ["r"])


def correlation_matrix(spark, d):
    return rnd(ST.correlation_matrix(V.features(spark, d), FEATURES), ["a", "b"], ["r", "strength", "distance"])


def top_correlations(spark, d):
    m = ST.correlation_matrix(V.features(spark, d), FEATURES).where("a < b")
    return rnd(TB.top_absolute(m, "r", 3, "a", "b"), ["a", "b"], ["r"])


def correlation_tests(spark, d):
    out = None
    for m in ("pearson", "spearman", "kendall", "skipped"):
        t = ST.correlation_table(V.features(spark, d), ["l_quantity"], ["l_discount", "l_tax"], None, m).withColumn("method", F.lit(m))
        out = t if out is None else out.unionByName(t)
    return rnd(out, ["method", "x", "y", "n"], ["r", "ci_low", "ci_high", "p_val", "power"])


def adjusted_correlations(spark, d):
    t = ST.adjusted_table(V.features(spark, d), ["is_r"], FEATURES, ["spearman", "pearson"])
    return rnd(t, ["method", "x", "y"], ["r", "p_val", "adjusted_p_value", "ci_low_adj", "ci_high_adj"])


def ranksum_table(spark, d):
    t = ST.ranksum_table(V.spread_features(spark, d), ["is_r"], FEATURES, None)
    return rnd(t, ["x", "y"], ["stats", "cohen"], 5)


def ttest_table(spark, d):
    t = ST.ttest_table(V.features(spark, d), ["is_r"], FEATURES, None)
    return rnd(t, ["x", "y", "dof"], ["T", "cohen_d"], 5)


def ttest_p(spark, d):
    return rnd(ST.ttest_table(V.features(spark, d), ["is_r"], FEATURES, None), ["x", "y"], ["p_val"])


def ranksum_p(spark, d):
    return rnd(ST.ranksum_table(V.spread_features(spark, d), ["is_r"], FEATURES, None), ["x", "y"], ["pval"])


def correlation_p(spark, d):
    """p and 95 % interval of three correlations; Kendall's p is corrected for ties."""
    out = None
    for m in ("pearson", "spearman", "kendall"):
        t = ST.correlation_table(V.features(spark, d), ["l_quantity"], ["l_discount", "l_tax"], None, m).withColumn("method", F.lit(m))
        out = t if out is None else out.unionByName(t)
    return rnd(out, ["method", "x", "y", "n"], ["r", "ci_low", "ci_high", "p_val"], 5)


def anova_effects(spark, d):
    return rnd(ST.anova_table(_three(spark, d), ["l_returnflag", "third"], FEATURES, None), ["x", "y"], ["np2"], 7)


def spearman_matrix(spark, d):
    return rnd(ST.correlation_matrix(V.features(spark, d), FEATURES, "spearman"), ["a", "b"], ["r", "strength", "distance"])


def reliability_table(spark, d):
    """Cross-condition reliability with p, adjusted p and the two thresholds."""
    return rnd(ST.reliability(_paired(spark, d), _ICC), ["feature", "n", "reliable"], ["r", "p_val", "adjusted_p_value"], 5)


def cohen_table(spark, d):
    t = ST.cohen_table(V.features(spark, d), "l_returnflag", "R", "A", FEATURES)
    return rnd(t, ["x", "y"], ["cohen"])


def _three(spark, d):
    return V.features(spark, d).withColumn("third", c("l_linenumber") % 3)


def anova_table(spark, d):
    t = ST.anova_table(_three(spark, d), ["l_returnflag", "third"], FEATURES, None)
    return rnd(t, ["x", "y"], ["F", "p_unc"], 5)


def significant_anova(spark, d):
    """Only the tests with p below the threshold."""
    return ST.anova_table(_three(spark, d), ["l_returnflag", "third"], FEATURES, 0.3).select("x", "y")


def bh_adjust(spark, d):
    t = ST.anova_table(_three(spark, d), ["l_returnflag", "third"], FEATURES, None)
    return rnd(ST.adjust_bh(t, "p_unc"), ["x", "y"], ["p_unc", "adjusted_p_value"], 5)


def _paired(spark, d):
    return TB.paired_conditions(V.subject_values(spark, d), "subj", "stim", "routine", "cinderella")


_ICC = {f: (f"{f}_routine", f"{f}_cinderella") for f in ("mean_value", "n_events")}


def icc21(spark, d):
    return rnd(ST.icc_table(_paired(spark, d), _ICC), ["feature", "n", "interpretation"], ["icc", "F"])


def icc_summary(spark, d):
    return ST.icc_summary(ST.icc_table(_paired(spark, d), _ICC))


def condition_reliability(spark, d):
    """Correlation of each feature across the two conditions."""
    p = _paired(spark, d)
    return rnd(ST.correlate(p, list(_ICC.values())), ["x", "y", "n"], ["r"])


def zscore(spark, d):
    e = V.table(spark, d, "events").select("event_id", "value")
    return rnd(zscores(e, ["value"]), ["event_id"], ["z_value"])


def robust_scale(spark, d):
    s = ST.robust_scale(V.spread_features(spark, d), ["l_quantity", "l_extendedprice"], "l_returnflag")
    return rnd(s, ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_quantity", "l_extendedprice"])


def shift_non_negative(spark, d):
    base = V.table(spark, d, "customer").select("c_custkey", c("c_acctbal").alias("x"))
    return rnd(ST.shift_non_negative(base, ["x"]), ["c_custkey"], ["x"], 2)


def ols_coefficients(spark, d):
    t = G.hierarchical_ols(V.features(spark, d), "l_extendedprice", ["l_quantity", "l_discount"])["coefficients"]
    return rnd(t, ["term"], ["coef"], 2)


def ols_added_variance(spark, d):
    t = G.hierarchical_ols(V.features(spark, d), "l_extendedprice", ["l_quantity"], ["l_discount"])["added"]
    return rnd(t, ["term"], ["R2_base", "R2_full", "delta_R2"])


def ols_residuals(spark, d):
    t = G.hierarchical_ols(V.features(spark, d), "l_extendedprice", ["l_quantity"])["residuals"]
    return rnd(t, ["l_orderkey", "l_linenumber"], ["semantic_residual"], 2)


def marginal_r2(spark, d):
    return rnd(G.marginal_r2(V.features(spark, d), "l_extendedprice", ["l_quantity", "l_discount"]), ["predictor"], ["contribution", "total_R2"])


def variance_report(spark, d):
    """All tables of the report in long form; residuals by their share of the target's variance."""
    t = G.variance_report(V.spread_features(spark, d), "l_extendedprice", ["l_quantity", "l_discount"])
    row = lambda section, name, value: [F.lit(section).alias("section"), name.alias("name"), F.round(value, 5).alias("value")]
    unexplained = F.avg(F.pow("semantic_residual", F.lit(2.0))) / F.var_pop("l_extendedprice")
    out = t["correlations"].select(*row("correlation", c("y"), c("r")))
    out = out.unionByName(t["added"].select(*row("added", c("term"), c("delta_R2"))))
    # a slope is told in standard deviations, so that its digits do not depend on the units
    sd = V.features(spark, d).agg(*[F.stddev_pop(n).alias(n) for n in ("l_quantity", "l_discount", "l_extendedprice")]).first()
    for n in ("l_quantity", "l_discount"):
        out = out.unionByName(t["coefficients"].where(c("term") == n).select(*row("slope", F.lit(n), c("coef") * F.lit(sd[n] / sd["l_extendedprice"]))))
    out = out.unionByName(t["residuals"].agg(unexplained.alias("v")).select(*row("residual", F.lit("unexplained"), c("v"))))
    return out.unionByName(t["shares"].select(*row("share", c("predictor"), c("contribution"))))


QUERIES = {
    f.__name__: f
    for f in (
        average_ranks, pearson_table, spearman_table, spearman_with_gaps, kendall_table, correlation_matrix, top_correlations,
        ttest_p, ranksum_p, correlation_p, anova_effects, spearman_matrix, reliability_table, correlation_tests, adjusted_correlations, ranksum_table, ttest_table, cohen_table, anova_table, significant_anova, bh_adjust,
        icc21, icc_summary, condition_reliability, zscore, robust_scale, shift_non_negative, ols_coefficients, ols_added_variance,
        ols_residuals, marginal_r2, variance_report,
    )
}


def _union(rows):
    return " UNION ALL ".join(rows)


_RANK = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


def _kendall(x: str, y: str) -> str:
    return f"""(WITH g AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM lineitem GROUP BY ALL),
  s AS (SELECT sum(CAST(a.n AS DOUBLE) * b.n * sign(b.y - a.y)) AS s FROM g a JOIN g b ON a.x < b.x),
  tx AS (SELECT sum(CAST(m AS DOUBLE) * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM g GROUP BY x)),
  ty AS (SELECT sum(CAST(m AS DOUBLE) * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM g GROUP BY y)),
  w AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS DOUBLE) * (count(*) - 1) / 2 AS t FROM lineitem)
  SELECT '{x}' AS x, '{y}' AS y, w.n, round(s.s / sqrt((w.t - tx.t) * (w.t - ty.t)), 6) AS r FROM s, tx, ty, w)"""


def _anova(extra: str) -> str:
    cells = _union(
        f"SELECT '{x}' AS x, '{y}' AS y, {e} AS g, CAST({y} AS DOUBLE) AS v FROM lineitem"
        for x, e in (("l_returnflag", "l_returnflag"), ("third", "CAST(l_linenumber % 3 AS VARCHAR)")) for y in FEATURES
    )
    return f"""WITH cells AS ({cells}),
t AS (SELECT x, y, count(*) AS n, avg(v) AS gm, var_pop(v) * count(*) AS sst FROM cells GROUP BY x, y),
b AS (SELECT x, y, g, count(*) AS n, avg(v) AS m FROM cells GROUP BY x, y, g),
ss AS (SELECT t.x, t.y, t.n, sst, sum(b.n * (b.m - gm) * (b.m - gm)) AS ssb FROM t JOIN b ON t.x = b.x AND t.y = b.y GROUP BY ALL),
a AS (SELECT x, y, (ssb / 2) / ((sst - ssb) / (n - 3)) AS f, pow(1 - ssb / sst, (n - 3) / 2.0) AS p FROM ss)
{extra}"""


_PAIRED = """v AS (SELECT user_id AS subj, event_type AS t, avg(value) AS mean_value, CAST(count(*) AS DOUBLE) AS n_events FROM events GROUP BY ALL),
pr AS (SELECT r.subj, r.mean_value AS mr, p.mean_value AS mp, r.n_events AS nr, p.n_events AS np FROM v r JOIN v p USING (subj) WHERE r.t = 'click' AND p.t = 'purchase')"""
_ICC_SQL = f"""WITH {_PAIRED},
l AS (SELECT 'mean_value' AS feature, subj, 1 AS k, mr AS v FROM pr UNION ALL SELECT 'mean_value', subj, 2, mp FROM pr
      UNION ALL SELECT 'n_events', subj, 1, nr FROM pr UNION ALL SELECT 'n_events', subj, 2, np FROM pr),
g AS (SELECT feature, avg(v) AS gm, count(DISTINCT subj) AS n, var_pop(v) * count(*) AS sst FROM l GROUP BY feature),
r AS (SELECT feature, sum(2 * (m - gm) * (m - gm)) AS ssr FROM (SELECT feature, subj, avg(v) AS m FROM l GROUP BY ALL) JOIN g USING (feature) GROUP BY feature),
k AS (SELECT feature, sum(n * (m - gm) * (m - gm)) AS ssc FROM (SELECT feature, k, avg(v) AS m FROM l GROUP BY ALL) JOIN g USING (feature) GROUP BY feature),
ms AS (SELECT feature, n, ssr / (n - 1) AS msr, ssc AS msc, (sst - ssr - ssc) / (n - 1) AS mse FROM g JOIN r USING (feature) JOIN k USING (feature)),
i AS (SELECT feature, n, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc, msr / mse AS f FROM ms),
o AS (SELECT feature, n, icc, f, CASE WHEN icc < 0.5 THEN 'poor' WHEN icc < 0.75 THEN 'moderate' WHEN icc < 0.9 THEN 'good' ELSE 'excellent' END AS b FROM i)
"""
_TWO = """m AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,
  covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y, covar_pop(l_extendedprice, l_extendedprice) AS syy,
  avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
q AS (SELECT *, (b1 * s1y + b2 * s2y) / syy AS rf, s1y * s1y / s11 / syy AS r1, s2y * s2y / s22 / syy AS r2 FROM b)"""
_GRP = lambda f, a, b: f"""SELECT avg({f}) FILTER ({a}) AS ma, avg({f}) FILTER ({b}) AS mb, var_samp({f}) FILTER ({a}) AS va, var_samp({f}) FILTER ({b}) AS vb,
  count(*) FILTER ({a}) AS na, count(*) FILTER ({b}) AS nb FROM lineitem"""
_RA = lambda f: _GRP(f, "l_returnflag = 'R'", "l_returnflag = 'A'")
_SD = "sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))"
_CORR = lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem"

# Two-sided tails by Simpson's rule over [0, |t|], written out in SQL.
_SIMPSON = lambda t, f: f"greatest(0, 1 - 2 * {t} / 6000 * (SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f.replace('$', f'({t} * i / 2000)')}) FROM range(0, 2001) AS s(i)))"
_NORM_P = lambda z: _SIMPSON(f"least(abs({z}), 40)", "exp(-$ * $ / 2) / sqrt(2 * pi())")
_T_P = lambda t, k: _SIMPSON(f"least(abs({t}), 200)", f"exp(lgamma(({k} + 1) / 2.0) - lgamma({k} / 2.0) - ln({k} * pi()) / 2 - ({k} + 1) / 2.0 * ln(1 + $ * $ / {k}))")
_R_P = _T_P("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")
_KENDALL_P = lambda x, y: f"""(WITH g AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM lineitem GROUP BY ALL),
  s AS (SELECT sum(CAST(a.n AS DOUBLE) * b.n * sign(b.y - a.y)) AS s FROM g a JOIN g b ON a.x < b.x),
  tx AS (SELECT sum(m * (m - 1) / 2) AS t, sum(m * (m - 1) * (m - 2)) AS u, sum(m * (m - 1) * (2 * m + 5)) AS v FROM (SELECT CAST(sum(n) AS DOUBLE) AS m FROM g GROUP BY x)),
  ty AS (SELECT sum(m * (m - 1) / 2) AS t, sum(m * (m - 1) * (m - 2)) AS u, sum(m * (m - 1) * (2 * m + 5)) AS v FROM (SELECT CAST(sum(n) AS DOUBLE) AS m FROM g GROUP BY y)),
  w AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem),
  z AS (SELECT w.n, s.s / sqrt((w.n * (w.n - 1) / 2 - tx.t) * (w.n * (w.n - 1) / 2 - ty.t)) AS r,
    s.s / sqrt((w.n * (w.n - 1) * (2 * w.n + 5) - tx.v - ty.v) / 18 + 2 * tx.t * ty.t / (w.n * (w.n - 1)) + tx.u * ty.u / (9 * w.n * (w.n - 1) * (w.n - 2))) AS z FROM s, tx, ty, w)
  SELECT 'kendall' AS method, '{x}' AS x, '{y}' AS y, n, r, {_NORM_P('z')} AS p FROM z)"""

ORACLES = {
    "ttest_p": _union(
        f"""SELECT x, y, round({_T_P('t', 'k')}, 6) AS p_val FROM (SELECT 'is_r' AS x, '{f}' AS y, (ma - mb) / ({_SD} * sqrt(1.0 / na + 1.0 / nb)) AS t, (na + nb - 2)::DOUBLE AS k
        FROM ({_GRP(f, "l_returnflag <> 'R'", "l_returnflag = 'R'")}))""" for f in FEATURES
    ),
    "ranksum_p": _union(
        f"""SELECT x, y, round({_NORM_P('z')}, 6) AS pval FROM (SELECT 'is_r' AS x, '{f}' AS y, (r1 - n1 * (n + 1) / 2.0) / sqrt(n1 * (n - n1) * (n + 1) / 12.0) AS z
        FROM (SELECT sum(a) FILTER (g) AS r1, CAST(count(*) FILTER (g) AS DOUBLE) AS n1, count(*) AS n FROM (SELECT {_RANK(f)} AS a, l_returnflag = 'R' AS g FROM lineitem)))""" for f in FEATURES
    ),
    "correlation_p": "SELECT method, x, y, n::BIGINT AS n, round(r, 5) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 5) AS ci_low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 5) AS ci_high, round(p, 5) AS p_val FROM ("
    + _union(
        f"SELECT *, {_R_P} AS p FROM (SELECT '{m}' AS method, 'l_quantity' AS x, '{y}' AS y, count(*)::DOUBLE AS n, corr(a, b) AS r FROM (SELECT {g('l_quantity')} AS a, {g(y)} AS b FROM lineitem))"
        for m, g in (("pearson", lambda v: v), ("spearman", _RANK)) for y in ("l_discount", "l_tax")
    )
    + " UNION ALL " + _union(f"SELECT * FROM {_KENDALL_P('l_quantity', y)}" for y in ("l_discount", "l_tax")) + ")",
    "anova_effects": _anova("SELECT x, y, round(ssb / sst, 7) AS np2 FROM ss"),
    "spearman_matrix": "SELECT a, b, round(r, 6) AS r, round(abs(r), 6) AS strength, round(1 - abs(r), 6) AS distance FROM ("
    + _union(f"SELECT '{a}' AS a, '{b}' AS b, corr(u, v) AS r FROM (SELECT {_RANK(a)} AS u, {_RANK(b)} AS v FROM lineitem)" if a != b else f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS r" for a in FEATURES for b in FEATURES) + ")",
    "reliability_table": f"""WITH {_PAIRED},
c AS (SELECT 'mean_value' AS feature, count(*)::DOUBLE AS n, corr(mr, mp) AS r FROM pr UNION ALL SELECT 'n_events', count(*)::DOUBLE, corr(nr, np) FROM pr),
p AS (SELECT *, {_R_P} AS p FROM c), k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p),
j AS (SELECT *, (SELECT least(min(o.p * o.m / o.i), 1.0) FROM k o WHERE o.i >= k.i) AS q FROM k)
SELECT feature, n::BIGINT AS n, abs(r) > 0.05 AND q < 0.1 AS reliable, round(r, 5) AS r, round(p, 5) AS p_val, round(q, 5) AS adjusted_p_value FROM j""",
    "average_ranks": _union(
        f"""SELECT DISTINCT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, count(*) OVER (PARTITION BY {f}) AS n, rank() OVER (ORDER BY {f}) - 1 AS before,
        count(*) OVER () AS total, CAST({_RANK(f)} AS DOUBLE) AS avg_rank FROM lineitem""" for f in ("l_quantity", "l_discount", "l_extendedprice")
    ),
    "pearson_table": _union(f"SELECT 'is_r' AS x, '{f}' AS y, count(*) AS n, round(corr(CAST(l_returnflag = 'R' AS INT), {f}), 6) AS r FROM lineitem" for f in FEATURES),
    "spearman_table": _union(
        f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT {_RANK(e)} AS a, {_RANK(y)} AS b FROM lineitem)"
        for x, e, y in [("is_r", "(l_returnflag = 'R')", f) for f in FEATURES] + [("l_quantity", "l_quantity", "l_extendedprice")]
    ),
    "spearman_with_gaps": _union(
        f"SELECT 'q' AS x, '{n}' AS y, count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT {_RANK('l_quantity')} AS a, {_RANK(y)} AS b FROM lineitem WHERE {w})"
        for n, y, w in (("p", "l_extendedprice", "l_discount > 0.01 AND l_tax > 0.01"), ("l_tax", "l_tax", "l_discount > 0.01"))
    ),
    "kendall_table": _union(f"SELECT * FROM {_kendall(x, y)}" for x, y in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))),
    "correlation_matrix": f"""SELECT a, b, round(r, 6) AS r, round(abs(r), 6) AS strength, round(1 - abs(r), 6) AS distance FROM (
{_union(_CORR(a, b) if a != b else f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS r" for a in FEATURES for b in FEATURES)})""",
    "top_correlations": f"SELECT a, b, round(r, 6) AS r FROM ({_union(_CORR(a, b) for a in FEATURES for b in FEATURES if a < b)}) ORDER BY abs(r) DESC LIMIT 3",
    "ranksum_table": _union(
        f"""SELECT 'is_r' AS x, '{f}' AS y, round((r1 - n1 * (n + 1) / 2.0) / sqrt(n1 * (n - n1) * (n + 1) / 12.0), 5) AS stats, round((ma - mb) / {_SD}, 5) AS cohen
        FROM (SELECT sum(a) FILTER (g) AS r1, CAST(count(*) FILTER (g) AS DOUBLE) AS n1, count(*) AS n FROM (SELECT {_RANK(f)} AS a, l_returnflag = 'R' AS g FROM lineitem)),
        ({_GRP(f, "l_returnflag = 'R'", "l_returnflag <> 'R'")})""" for f in FEATURES
    ),
    "ttest_table": _union(
        f"""SELECT 'is_r' AS x, '{f}' AS y, na + nb - 2 AS dof, round((ma - mb) / ({_SD} * sqrt(1.0 / na + 1.0 / nb)), 5) AS T, round(abs(ma - mb) / {_SD}, 5) AS cohen_d
        FROM ({_GRP(f, "l_returnflag <> 'R'", "l_returnflag = 'R'")})""" for f in FEATURES
    ),
    "cohen_table": _union(
        f"SELECT 'l_returnflag' AS x, '{f}' AS y, round((ma - mb) / {_SD}, 6) AS cohen FROM ({_RA(f)})"
        for f in FEATURES
    ),
    "anova_table": _anova("SELECT x, y, round(f, 5) AS F, round(p, 5) AS p_unc FROM a"),
    "significant_anova": _anova("SELECT x, y FROM a WHERE p <= 0.3"),
    "bh_adjust": _anova(
        """, k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM a)
SELECT x, y, round(p, 5) AS p_unc, round((SELECT least(min(j.p * j.m / j.r), 1.0) FROM k j WHERE j.r >= k.r), 5) AS adjusted_p_value FROM k"""
    ),
    "icc21": _ICC_SQL + "SELECT feature, n, b AS interpretation, round(icc, 6) AS icc, round(f, 6) AS F FROM o",
    "icc_summary": _ICC_SQL + "SELECT b AS interpretation, count(*) AS n, count(*) FILTER (icc > 0.5) AS selected FROM o GROUP BY b",
    "condition_reliability": f"""WITH {_PAIRED}
SELECT 'mean_value_routine' AS x, 'mean_value_cinderella' AS y, count(*) AS n, round(corr(mr, mp), 6) AS r FROM pr
UNION ALL SELECT 'n_events_routine', 'n_events_cinderella', count(*), round(corr(nr, np), 6) FROM pr""",
    "zscore": "SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS z_value FROM events",
    "robust_scale": """
WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS a1, quantile_cont(l_quantity, 0.5) AS a2, quantile_cont(l_quantity, 0.75) AS a3,
  quantile_cont(l_extendedprice, 0.25) AS b1, quantile_cont(l_extendedprice, 0.5) AS b2, quantile_cont(l_extendedprice, 0.75) AS b3 FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, round((l_quantity - a2) / (a3 - a1), 6) AS l_quantity, round((l_extendedprice - b2) / (b3 - b1), 6) AS l_extendedprice
FROM lineitem JOIN q USING (l_returnflag)""",
    "shift_non_negative": "SELECT c_custkey, round(c_acctbal + abs((SELECT min(c_acctbal) FROM customer)), 2) AS x FROM customer",
    "ols_coefficients": f"""WITH {_TWO}
SELECT 'const' AS term, round(my - b1 * m1 - b2 * m2, 2) AS coef FROM q UNION ALL SELECT 'l_quantity', round(b1, 2) FROM q UNION ALL SELECT 'l_discount', round(b2, 2) FROM q""",
    "ols_added_variance": f"WITH {_TWO} SELECT 'syntax_block' AS term, round(r2, 6) AS R2_base, round(rf, 6) AS R2_full, round(rf - r2, 6) AS delta_R2 FROM q",
    "ols_residuals": """
WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_extendedprice - a - b * l_quantity, 2) AS semantic_residual FROM lineitem, r""",
    "marginal_r2": f"""WITH {_TWO}
SELECT 'l_quantity' AS predictor, round((r1 + rf - r2) / 2, 6) AS contribution, round(rf, 6) AS total_R2 FROM q
UNION ALL SELECT 'l_discount', round((r2 + rf - r1) / 2, 6), round(rf, 6) FROM q""",
    "variance_report": f"""WITH {_TWO}
"""
    + _union(f"SELECT 'correlation' AS section, '{x}' AS name, round(corr(a, b), 5) AS value FROM (SELECT {_RANK('l_extendedprice')} AS a, {_RANK(x)} AS b FROM lineitem)" for x in ("l_quantity", "l_discount"))
    + """
UNION ALL SELECT 'added', 'syntax_block', round(rf, 5) FROM q
UNION ALL SELECT 'slope', 'l_quantity', round(b1 * sqrt(s11 / syy), 5) FROM q UNION ALL SELECT 'slope', 'l_discount', round(b2 * sqrt(s22 / syy), 5) FROM q
UNION ALL SELECT 'residual', 'unexplained', round(1 - rf, 5) FROM q
UNION ALL SELECT 'share', 'l_quantity', round((r1 + rf - r2) / 2, 5) FROM q UNION ALL SELECT 'share', 'l_discount', round((r2 + rf - r1) / 2, 5) FROM q""",
}

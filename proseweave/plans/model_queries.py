"""Registered queries: classifier evaluation, splits, matching, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cca as CC
from ..operators import evaluation as EV
from ..operators import feature_groups as FG
from ..operators import learn as LN
from ..operators import matching as MT
from ..operators import permute as PM
from . import views as V

c = F.col


def _cm(spark, d):
    return EV.confusion(V.predictions(spark, d), V.CLASSES)


def confusion(spark, d):
    return _cm(spark, d)


def confusion_shares(spark, d):
    return EV.normalised(_cm(spark, d)).select("true", "pred", F.round("share", 6).alias("share"))


def class_report(spark, d):
    r = EV.class_report(_cm(spark, d))
    return r.select("label", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")], "support")


def accuracy_f1(spark, d):
    return EV.accuracy_f1(_cm(spark, d)).select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_score", 6).alias("f1_score"))


def adjusted_errors(spark, d):
    return EV.adjusted_errors(_cm(spark, d)).select("category", "errors", "possible", F.round("rate", 6).alias("rate"))


def error_shares(spark, d):
    return EV.error_shares(_cm(spark, d)).select("category", "errors", F.round("share", 6).alias("share"))


def context_auc(spark, d):
    return EV.context_auc(_cm(spark, d)).select("context", F.round("auc", 6).alias("auc"))


def undersampled(spark, d):
    return EV.undersample(V.predictions(spark, d).select("doc_id", "true"), "true", "doc_id")


def group_split(spark, d):
    return EV.group_split(V.predictions(spark, d).select("doc_id", "source"), "source")


def band_filter(spark, d):
    p = V.predictions(spark, d).select("doc_id", F.regexp_extract("true", "^(.*)_with", 1).alias("temperature_enc"))
    return MT.filter_rows(p, "no_medium_temperature")[0]


def _model_rows(spark, d):
    """Documents with numeric features, six-class code and treatment arm."""
    rows = V.labelled(spark, d).join(V.predictions(spark, d).select("doc_id", "true"), "doc_id")
    code = F.array_position(F.array(*[F.lit(x) for x in V.CLASSES]), c("true")) - 1
    return rows.select(
        "doc_id", "source", "lang", c("toxic").cast("int").alias("toxic"), code.cast("int").alias("cat_label"),
        F.log(c("n_chars") + 1.0).alias("size_score"), (c("n_chars") % 97 / 97.0).alias("noise_score"), (c("lang") == "en").cast("double").alias("english_score"),
    )


COVARIATES = ["size_score", "noise_score", "english_score"]


def psm_match(spark, d):
    rows = MT.propensity(_model_rows(spark, d), "toxic", COVARIATES)
    return MT.match_nearest(rows, "doc_id", "toxic", "logit").select("treated", "control", F.round("gap", 6).alias("gap"))


def nearest_match(spark, d):
    """Customers of two segments paired with those of the others by balance."""
    rows = V.table(spark, d, "customer").select(
        "c_custkey", c("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("t"), (c("c_acctbal") / 100.0).alias("s")
    )
    return MT.match_nearest(rows, "c_custkey", "t", "s", 0.2).select("treated", "control", F.round("gap", 6).alias("gap"))


def caliper_match(spark, d):
    """As ``nearest_match``, of scores that no two customers share, so that the greedy matching is one for any reader."""
    rows = V.table(spark, d, "customer").select(
        "c_custkey", c("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("t"), (c("c_acctbal") / 100.0 + c("c_custkey") / 1e9).alias("s")
    )
    return MT.match_nearest(rows, "c_custkey", "t", "s", 0.2).select("treated", "control", F.round("gap", 6).alias("gap"))


def psm_filter(spark, d):
    """Paraphrased low-temperature rows kept with their matched controls: the rows kept, and how many there were."""
    rows = _model_rows(spark, d).join(V.predictions(spark, d).select("doc_id", c("true").alias("combined_label")), "doc_id")
    # size_score would part the arms, which are told by size
    kept, counts = MT.filter_rows(rows, "psm", ["noise_score", "english_score"], "doc_id")
    sizes = {x: counts.select(x).scalar() for x in ("before", "after")}
    return kept.groupBy("combined_label").agg(F.count(F.lit(1)).alias("n")).withColumns(sizes)


def forest_evaluation(spark, d):
    sets = {"all": COVARIATES, "size": ["size_score"]}
    t, _ = LN.train_and_evaluate(_model_rows(spark, d), sets, "cat_label", "source", 6, {"all": {"n_estimators": 10, "max_depth": 5}, "size": {"n_estimators": 10, "max_depth": 5}})
    return t


def boosted_evaluation(spark, d):
    t, _ = LN.train_and_evaluate(_model_rows(spark, d), {"all": COVARIATES}, "cat_label", "source", 6, kind="boosted", rounds=5)
    return t


def permutation_importance(spark, d):
    split = EV.group_split(_model_rows(spark, d), "source").withColumn("label", c("cat_label").cast("double"))
    model = LN.forest({"n_estimators": 10, "max_depth": 5}).fit(LN.vectorise(split.where(~c("is_test")), COVARIATES))
    return LN.permutation_importance(model, split.where("is_test"), COVARIATES, "doc_id", repeats=10)


def stratified_folds(spark, d):
    f = LN.stratified_folds(_model_rows(spark, d), "source", "cat_label")
    return f.groupBy("fold", "cat_label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


def random_search(spark, d):
    grid = {"n_estimators": [5, 10], "max_depth": [3, 5], "min_samples_split": [2], "min_samples_leaf": [1, 2], "bootstrap": [True]}
    return LN.random_search(_model_rows(spark, d), COVARIATES, "cat_label", "source", draws=3, grid=grid)


XS, YS = ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax", "l_linenumber"]


def _blocks(spark, d):
    """Orders with averaged line features in two blocks."""
    l = V.table(spark, d, "lineitem")
    return l.groupBy("l_orderkey").agg(*[F.avg(x).alias(x) for x in (*XS, *YS)])


def sparse_cca(spark, d):
    return CC.nested_search(_blocks(spark, d), XS, YS, "l_orderkey", {"alpha": [0.001, 0.01], "l1_ratio": [0.5, 1], "latent_dimensions": [1, 2]})["folds"]


def _variates(spark, d):
    import numpy as np

    return CC.variates(_blocks(spark, d), XS, YS, np.array([[1.0], [0.001]]), np.array([[1.0], [2.0], [0.0]]))


def canonical_loadings(spark, d):
    t = CC.loadings(_variates(spark, d), [*XS, *YS], ["u1", "v1"])
    return t.select("x", "y", "n", F.round("r", 6).alias("r"))


def permutation_pvalue(spark, d):
    return CC.permutation_test(_variates(spark, d), "l_orderkey", 1).withColumn("r", F.round("r", 6))


FEATS = V.FEATURES


def feature_clusters(spark, d):
    return FG.by_clustering(V.features(spark, d), FEATS, threshold=0.9, method="pearson")


def _scaled(spark, d):
    return V.features(spark, d).select((c("l_quantity") / 50).alias("q"), (c("l_extendedprice") / 1e5).alias("p"), (c("l_discount") * 10).alias("d"), (c("l_tax") * 12.5).alias("t"))


def _loads(t):
    return t.select("component", "feature", F.round("loading", 5).alias("loading"), "selected")


def feature_pca(spark, d):
    return _loads(FG.by_pca(_scaled(spark, d), ["q", "p", "d", "t"], 2, 0.2))


def feature_factors(spark, d):
    return _loads(FG.by_factor_analysis(_scaled(spark, d), ["q", "p", "d", "t"], 2, 0.4))


def feature_ica(spark, d):
    return _loads(FG.by_ica(_scaled(spark, d), ["q", "p", "d", "t"], 2, 0.5, steps=15))


def feature_nmf(spark, d):
    return _loads(FG.by_nmf(_scaled(spark, d), ["q", "p", "d", "t"], 2, 0.4, steps=10))


QUERIES = {
    f.__name__: f
    for f in (
        confusion, confusion_shares, class_report, accuracy_f1, adjusted_errors, error_shares, context_auc, undersampled, group_split,
        band_filter, psm_match, nearest_match, caliper_match, psm_filter, forest_evaluation, boosted_evaluation, permutation_importance, stratified_folds, random_search,
        sparse_cca, canonical_loadings, permutation_pvalue, feature_clusters, feature_pca, feature_factors, feature_ica, feature_nmf,
    )
}

_PRED = """p AS (SELECT doc_id, source,
  CASE WHEN n_chars < 800 THEN 'low' WHEN n_chars < 2500 THEN 'medium' ELSE 'high' END AS tt, quality = 1 AS tp,
  CASE WHEN n_chars < 1000 THEN 'low' WHEN n_chars < 2000 THEN 'medium' ELSE 'high' END AS pt, toxic = 0 AS pp
  FROM documents JOIN labels USING (doc_id)),
nm AS (SELECT *, tt || '_temperature_with_' || CASE WHEN tp THEN 'paraphrase' ELSE 'no_paraphrase' END AS "true",
  pt || '_temperature_with_' || CASE WHEN pp THEN 'paraphrase' ELSE 'no_paraphrase' END AS pred FROM p)"""
_CLS = """cls AS (SELECT t || '_temperature_with_' || q AS l, t, o, q = 'paraphrase' AS w FROM (VALUES ('low', 1), ('medium', 2), ('high', 3)) a(t, o), (VALUES ('paraphrase'), ('no_paraphrase')) b(q))"""
_REP = f"""WITH {_PRED}, {_CLS},
r AS (SELECT l AS label, (SELECT count(*) FROM nm WHERE nm."true" = l AND nm.pred = l) AS tp, (SELECT count(*) FROM nm WHERE nm.pred = l) AS pr,
  (SELECT count(*) FROM nm WHERE nm."true" = l) AS support FROM cls),
f AS (SELECT label, coalesce(tp / nullif(pr, 0), 0.0) AS pre, coalesce(tp / nullif(support, 0), 0.0) AS rec, coalesce(2 * tp / nullif(pr + support, 0), 0.0) AS f1, support FROM r)
"""
_ORD = "CASE {x} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_ELIG = {
    "paraphrase": "a.t = b.t AND a.w <> b.w", "temperature": "a.t <> b.t AND a.w = b.w",
    "dissociate": "(NOT a.w AND b.w AND b.o > a.o) OR (a.w AND NOT b.w AND a.o > b.o)",
}
_N = lambda cond: f"(SELECT CAST(count(*) AS DOUBLE) FROM nm WHERE {cond})"


def _auc(band: str) -> str:
    yes, no = f"'{band}_with_paraphrase'", f"'{band}_with_no_paraphrase'"
    p1, n1 = _N(f'"true" = {yes} AND pred = {yes}'), _N(f'"true" = {yes} AND pred = {no}')
    n0 = _N(f'"true" = {no} AND pred = {no}')
    p0 = _N(f'("true" = {no} AND pred = {yes}) OR ("true" NOT IN ({yes}, {no}) AND pred IN ({yes}, {no}))')
    return f"SELECT '{band}' AS context, round(({p1} * {n0} + ({p1} * {n1} + {p0} * {n0}) / 2) / nullif(({p1} + {p0}) * ({n1} + {n0}), 0), 6) AS auc"


def _shuffle_sql(shuffles: int, walks: int = 4) -> str:
    """Numbers ``i`` of table w and their donors in ``shuffles`` shuffles; n has the grid. A place beyond n is moved again."""
    first = "(((xor(x, k) * %d) & %d))" % (PM.FACTORS[0], PM.MASK)
    second = f"((xor({first}, {first} >> 15) * {PM.FACTORS[1]}) & {PM.MASK})"
    hashed = lambda x, key: f"xor({second}, {second} >> 14)".replace("(x, k)", f"({x}, {key})")
    keys = ", ".join(f"('0x' || substr(md5('42|' || rep || '|{s}'), 1, 7))::BIGINT AS k{s}" for s in range(PM.STEPS))
    out = f"SELECT rep, i, i // cols AS l, i % cols AS c, k.*, n.* FROM w, n, (SELECT rep, {keys} FROM range({shuffles}) t(rep)) k"
    kept = []
    for walk in range(walks):
        for s in range(PM.STEPS):
            new = f"(l + {hashed('c', f'k{s}')}) % grid AS l" if s % 2 == 0 else f"(c + {hashed('l', f'k{s}')}) % cols AS c"
            out = f"SELECT * REPLACE ({new}) FROM ({out})"
        kept.append(f"SELECT rep, i, l * cols + c AS donor FROM ({out}) WHERE l * cols + c < n")
        out = f"SELECT * FROM ({out}) WHERE l * cols + c >= n"
    return " UNION ALL ".join(kept)


ORACLES = {
    "permutation_pvalue": f"""
WITH w AS (SELECT l_quantity + 0.001 * l_extendedprice AS u, l_discount + 2 * l_tax AS v, i FROM (SELECT avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice,
  avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, row_number() OVER (ORDER BY l_orderkey) - 1 AS i FROM lineitem GROUP BY l_orderkey)),
n AS (SELECT n, grid, (n + grid - 1) // grid AS cols FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS grid FROM w)),
o AS (SELECT avg(u) AS mu, avg(v) AS mv, stddev_pop(u) AS du, stddev_pop(v) AS dv, corr(u, v) AS r FROM w),
p AS (SELECT rep, sum(w.u * y.v) AS s FROM ({_shuffle_sql(5000)}) x JOIN w ON w.i = x.i JOIN w AS y ON y.i = x.donor GROUP BY rep)
SELECT 1 AS dimension, round(any_value(r), 6) AS r, count(*) FILTER (round(abs((s / n - mu * mv) / (du * dv)), 12) >= round(abs(r), 12)) / 5000.0 AS p FROM p, n, o""",
    "confusion": f"""WITH {_PRED}, {_CLS}
SELECT a.l AS "true", b.l AS pred, (SELECT count(*) FROM nm WHERE nm."true" = a.l AND nm.pred = b.l) AS n FROM cls a, cls b""",
    "confusion_shares": f"""WITH {_PRED}, {_CLS}
SELECT a.l AS "true", b.l AS pred, round((SELECT count(*) FROM nm WHERE nm."true" = a.l AND nm.pred = b.l) / nullif((SELECT count(*) FROM nm WHERE nm."true" = a.l), 0), 6) AS share FROM cls a, cls b""",
    "class_report": _REP + "SELECT label, round(pre, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, support FROM f",
    "accuracy_f1": _REP + "SELECT round(sum(rec * support) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_score FROM f",
    "adjusted_errors": f"WITH {_PRED}, {_CLS} " + " UNION ALL ".join(
        f"""SELECT '{k}' AS category, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(s) AS BIGINT) AS possible, round(100.0 * sum(e) / sum(s), 6) AS rate FROM (
        SELECT (SELECT count(*) FROM nm WHERE nm."true" = a.l AND nm.pred = b.l) AS e, (SELECT count(*) FROM nm WHERE nm."true" = a.l) AS s FROM cls a, cls b WHERE {w})"""
        for k, w in _ELIG.items()
    ),
    "error_shares": f"WITH {_PRED} " + " UNION ALL ".join(
        f"""SELECT '{k}' AS category, count(*) FILTER ({w}) AS errors, round(100.0 * count(*) FILTER ({w}) / count(*) FILTER (tt <> pt OR tp <> pp), 6) AS share FROM p"""
        for k, w in {"paraphrase": "tt = pt AND tp <> pp", "temperature": "tt <> pt AND tp = pp", "both": "tt <> pt AND tp <> pp"}.items()
    ),
    "context_auc": f"WITH {_PRED} " + " UNION ALL ".join(_auc(b) for b in ("low_temperature", "medium_temperature", "high_temperature")),
    "undersampled": f"""WITH {_PRED},
r AS (SELECT doc_id, "true", row_number() OVER (PARTITION BY "true" ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42')) AS k FROM nm)
SELECT doc_id, "true" FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM nm GROUP BY "true"))""",
    "group_split": f"""WITH {_PRED},
g AS (SELECT source, row_number() OVER (ORDER BY md5(source || '|42')) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM p))
SELECT doc_id, source, k <= ceil(0.2 * n) AS is_test FROM p JOIN g USING (source)""",
    "canonical_loadings": """
WITH b AS (SELECT l_orderkey, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, avg(l_linenumber) AS l_linenumber
  FROM lineitem GROUP BY 1),
w AS (SELECT *, l_quantity + 0.001 * l_extendedprice AS u1, l_discount + 2 * l_tax AS v1 FROM b)
""" + " UNION ALL ".join(f"SELECT '{v}' AS x, '{x}' AS y, count(*) AS n, round(corr({v}, {x}), 6) AS r FROM w" for v in ("u1", "v1") for x in (*XS, *YS)),
    "caliper_match": """
WITH RECURSIVE r AS (SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS t, c_acctbal / 100.0 + c_custkey / 1e9 AS s FROM customer),
p AS (SELECT a.id AS treated, b.id AS control, abs(a.s - b.s) AS gap, md5(a.id::VARCHAR || '|' || b.id::VARCHAR) AS h FROM r a JOIN r b ON a.t AND NOT b.t AND b.s BETWEEN a.s - 0.2 AND a.s + 0.2),
m(treated, control, gap, h, taken) AS (
  SELECT treated, control, gap, h, false FROM p
  UNION ALL
  SELECT treated, control, gap, h, row_number() OVER (PARTITION BY treated ORDER BY gap, h) = 1 AND row_number() OVER (PARTITION BY control ORDER BY gap, h) = 1
  FROM (SELECT *, bool_or(taken) OVER (PARTITION BY treated) OR bool_or(taken) OVER (PARTITION BY control) AS over FROM m) WHERE NOT over)
SELECT treated, control, round(gap, 6) AS gap FROM m WHERE taken""",
    "band_filter": f"WITH {_PRED} SELECT doc_id, tt || '_temperature' AS temperature_enc FROM p WHERE tt <> 'medium'",
}

"""Registered queries: sentence vectors, distances and density scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density as N
from ..operators import distances as D
from ..operators import encode as E
from ..functions import vectors as VX
from . import sqltext as S
from . import views as V

c = F.col


def r6(name, out=None):
    return F.round(c(name), 6).alias(out or name)


def _rounded(df, keys, names):
    return df.select(*keys, *[r6(n) for n in names])


def word_mean_vectors(spark, d):
    toks = V.turn_tokens(spark, d)
    vecs = E.word_means(toks, V.word_vectors(spark, d, toks), 64)
    return vecs.select("story_id", "pos", F.posexplode("vec").alias("dim", "x")).select("story_id", "pos", "dim", r6("x"))


def known_word_counts(spark, d):
    toks = V.turn_tokens(spark, d)
    return E.known_tokens(toks, V.word_vectors(spark, d, toks)).groupBy("story_id", "pos").agg(F.count(F.lit(1)).alias("n"))


def hashed_vectors(spark, d):
    bag = V.turn_tokens(spark, d).select("story_id", "pos", F.posexplode(E.hashed_bag(c("tokens"), 64)).alias("dim", "n"))
    return bag.where("n > 0")


def encoded_distinct(spark, d):
    """A pluggable encoder run once per distinct sentence: here hashed bags, reported as norms."""
    from ..functions import text as T

    encoder = lambda df: df.select("sentence", E.hashed_bag(T.word_tokens(c("sentence")), 64).alias("vec"))
    coded = E.encode_distinct(V.turns(spark, d), encoder)
    return coded.select("story_id", "pos", F.round(VX.norm(c("vec")), 6).alias("norm"))


def paragraph_vector(spark, d):
    p = E.paragraph_vectors(V.story_vectors(spark, d))
    return p.select("story_id", F.posexplode("paragraph").alias("dim", "x")).select("story_id", "dim", r6("x"))


def consecutive_distance(spark, d):
    return _rounded(D.consecutive(V.story_vectors(spark, d)), ["story_id", "step"], ["d"])


def consecutive_summary(spark, d):
    return _rounded(D.summarise_steps(D.consecutive(V.story_vectors(spark, d))), ["story_id"], D.STATS)


def pairwise_summary(spark, d):
    return _rounded(D.pair_summary(V.story_vectors(spark, d)), ["story_id", "n_pairs"], D.STATS)


def pairwise_mean_linear(spark, d):
    return _rounded(D.pair_moments(V.story_vectors(spark, d)), ["story_id", "n"], ["mean"])


def _vector_index(vectors):
    n = vectors.groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    src, dst = V.paraphrase_index(c("n"), c("story_id"))
    return n.select("story_id", src.alias("src"), dst.alias("dst"))


def paraphrase_vs_rest(spark, d):
    v = V.story_vectors(spark, d)
    return _rounded(D.paraphrase_vs_rest(v, _vector_index(v)), ["story_id"], ["para_vs_others"])


def distance_summary_wide(spark, d):
    v = V.story_vectors(spark, d).select("story_id", "pos", "vec")
    wide = D.feature_table({"sentence_sim": v}, index=_vector_index(v))
    return _rounded(wide, ["story_id"], [x for x in wide.columns if x != "story_id"])


def jaccard_consecutive(spark, d):
    return _rounded(D.consecutive_jaccard(V.turn_tokens(spark, d)), ["story_id", "step"], ["d"])


def jaccard_summary(spark, d):
    return _rounded(D.pair_summary(V.turn_tokens(spark, d), "jaccard"), ["story_id", "n_pairs"], D.STATS)


def paraphrase_vs_rest_jaccard(spark, d):
    t = V.turn_tokens(spark, d)
    return _rounded(D.paraphrase_vs_rest(t, _vector_index(t), "jaccard"), ["story_id"], ["para_vs_others"])


def _consecutive_words(spark, d, metric):
    toks = V.turn_tokens(spark, d)
    return _rounded(D.consecutive_words(E.token_bags(toks), V.word_vectors(spark, d, toks), metric), ["story_id", "step"], ["d"])


def wmd_relaxed_consecutive(spark, d):
    return _consecutive_words(spark, d, "wmd_relaxed")


def wmd_consecutive(spark, d):
    return _consecutive_words(spark, d, "wmd")


def wmd_summary(spark, d):
    toks = V.turn_tokens(spark, d)
    return _rounded(D.pair_summary(E.token_bags(toks), "wmd", vocabulary=V.word_vectors(spark, d, toks)), ["story_id", "n_pairs"], D.STATS)


def narrative_speed(spark, d):
    v = V.story_vectors(spark, d)
    plain = N.narrative_speed(v, doubled=False, guard=False).select("story_id", c("speed").alias("plain_speed"))
    both = N.narrative_speed(v).join(plain, "story_id")
    return _rounded(both, ["story_id", "n"], ["speed", "speed_norm", "plain_speed"])


def trajectory_curve(spark, d):
    return _rounded(N.trajectory(V.story_vectors(spark, d)), ["story_id", "step"], ["d", "path"])


def trajectory_length(spark, d):
    return _rounded(N.trajectory_score(V.story_vectors(spark, d)), ["story_id"], ["trajectory_score"])


def silhouette_given_labels(spark, d):
    return _rounded(N.silhouette(V.story_vectors(spark, d)), ["story_id", "n", "n_labels"], ["silhouette"])


def cluster_scores_given_labels(spark, d):
    return _rounded(N.cluster_scores(V.story_vectors(spark, d)), ["story_id"], ["cluster_density", "reverse_silhouette"])


def cluster_members(spark, d):
    """Turns of each conversation listed by the length class they fall in."""
    t = V.turns(spark, d)
    labelled = t.select("story_id", "pos", (F.length("sentence") % 3).alias("label"))
    return N.cluster_members(labelled, t)


def cluster_labels_meanshift(spark, d):
    return N.cluster_labels(N.gather(V.story_vectors(spark, d)), "MeanShift").select("story_id", "pos", "label")


def cluster_labels_hdbscan(spark, d):
    return N.cluster_labels(N.gather(V.story_vectors(spark, d)), "HDBSCAN").select("story_id", "pos", "label")


def density_table(spark, d):
    t, names = N.density_table(V.story_vectors(spark, d))
    return _rounded(t, ["story_id", "num_sentences"], names)


def regression_variants(spark, d):
    vectors = V.story_vectors(spark, d)
    g = N.gather(vectors)
    out = vectors.select("story_id").distinct()
    for m in ("Ridge", "ElasticNet"):
        s = N.matrix_scores(g, m)
        out = out.join(s.select("story_id", f"regression_coef_density_score_{m}", f"regression_error_score_{m}"), "story_id", "left")
    return _rounded(out, ["story_id"], out.columns[1:])


QUERIES = {
    f.__name__: f
    for f in (
        word_mean_vectors, known_word_counts, hashed_vectors, encoded_distinct, paragraph_vector, consecutive_distance,
        consecutive_summary, pairwise_summary, pairwise_mean_linear, paraphrase_vs_rest, distance_summary_wide,
        jaccard_consecutive, jaccard_summary, paraphrase_vs_rest_jaccard, wmd_relaxed_consecutive, wmd_consecutive,
        wmd_summary, narrative_speed, trajectory_curve, trajectory_length, silhouette_given_labels,
        cluster_scores_given_labels, cluster_members, cluster_labels_meanshift, cluster_labels_hdbscan, density_table,
        regression_variants,
    )
}

_SV = "sv AS (SELECT vec_id // 8 AS story_id, vec_id % 8 AS pos, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_STEP = f"""{_SV},
st AS (SELECT a.story_id, a.pos AS step, 1 - list_cosine_similarity(a.vec, b.vec) AS d
       FROM sv a JOIN sv b ON a.story_id = b.story_id AND b.pos = a.pos + 1)"""
_PAIR = f"""{_SV},
pr AS (SELECT a.story_id, a.pos AS i, b.pos AS j, 1 - list_cosine_similarity(a.vec, b.vec) AS d
       FROM sv a JOIN sv b ON a.story_id = b.story_id AND b.pos > a.pos)"""
_FIVE = """round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median,
  round(stddev_pop(d), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max"""
_TOK = f"""tk AS (SELECT conv_id AS story_id, turn AS pos, {S.tokens('text')} AS toks FROM conversations),
tc AS (SELECT story_id, pos, t, count(*) AS n FROM (SELECT story_id, pos, unnest(toks) AS t FROM tk) GROUP BY ALL)"""
_VOC = """vocab AS (SELECT t, CAST(embedding AS DOUBLE[]) AS vec FROM (SELECT DISTINCT t FROM tc WHERE length(t) > 1) w
  JOIN embeddings e ON e.vec_id = CAST('0x' || substr(md5(w.t), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings))"""
_JPAIR = f"""{_TOK},
jp AS (SELECT a.story_id, a.pos AS i, b.pos AS j, len(a.toks) + len(b.toks) AS m
       FROM tk a JOIN tk b ON a.story_id = b.story_id AND b.pos > a.pos),
sh AS (SELECT a.story_id, a.pos AS i, b.pos AS j, sum(least(a.n, b.n)) AS s
       FROM tc a JOIN tc b ON a.story_id = b.story_id AND a.t = b.t AND b.pos > a.pos GROUP BY ALL),
jd AS (SELECT story_id, i, j, CASE WHEN m = 0 THEN 1.0 ELSE coalesce(s, 0) / (m - coalesce(s, 0)) END AS d
       FROM jp LEFT JOIN sh USING (story_id, i, j))"""
_LONE = "UNION ALL SELECT {k}, CAST(1 AS BIGINT), 1.0, 1.0, 0.0, 1.0, 1.0 FROM {t} GROUP BY {k} HAVING count(*) = 1"


def _wide() -> str:
    a = ", ".join(f"{x} AS sentence_sim_all_cosine_sentences_similarity_{s}" for s, x in _STATSQL.items())
    b = ", ".join(f"{x} AS sentence_sim_consecutive_cosine_sentences_similarity_{s}" for s, x in _STATSQL.items())
    return f"""WITH {_PAIR},
st AS (SELECT story_id, d FROM pr WHERE j = i + 1),
n AS (SELECT story_id, count(*) AS n FROM sv GROUP BY story_id),
x AS (SELECT story_id, n - 1 AS dst, story_id % (n - 1) AS src FROM n WHERE n > 2),
pv AS (SELECT x.story_id, max(d) FILTER (i = src AND j = dst) - avg(d) FILTER (j <> dst) AS v FROM x JOIN pr USING (story_id) GROUP BY x.story_id)
SELECT * FROM (SELECT story_id, {a} FROM pr GROUP BY story_id) JOIN (SELECT story_id, {b} FROM st GROUP BY story_id) USING (story_id)
LEFT JOIN (SELECT story_id, round(v, 6) AS sentence_sim_para_vs_others_cosine_sentences_similarity FROM pv) USING (story_id)"""


_STATSQL = {
    "mean": "round(avg(d), 6)", "median": "round(quantile_cont(d, 0.5), 6)", "std": "round(stddev_pop(d), 6)",
    "min": "round(min(d), 6)", "max": "round(max(d), 6)",
}

_SIL = f"""WITH {_SV},
ds AS (SELECT a.story_id, a.pos, a.label AS own, b.label AS other, avg(list_distance(a.vec, b.vec)) AS m
       FROM sv a JOIN sv b ON a.story_id = b.story_id AND a.pos <> b.pos GROUP BY ALL),
pt AS (SELECT story_id, pos, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM ds GROUP BY ALL),
sc AS (SELECT story_id, avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS s FROM pt GROUP BY ALL),
sz AS (SELECT story_id, count(*) AS n, count(DISTINCT label) AS n_labels FROM sv GROUP BY ALL),
fin AS (SELECT story_id, n, n_labels, CASE WHEN n_labels > 1 AND n_labels < n THEN s END AS s FROM sz JOIN sc USING (story_id))
"""

ORACLES = {
    "word_mean_vectors": f"""WITH {_TOK}, {_VOC},
x AS (SELECT tc.story_id, tc.pos, k - 1 AS dim, sum(n * vec[k]) / sum(n) AS x FROM tc JOIN vocab USING (t), range(1, 65) g(k) GROUP BY ALL),
z AS (SELECT story_id, pos, k - 1 AS dim FROM tk, range(1, 65) g(k))
SELECT story_id, pos, CAST(dim AS INTEGER) AS dim, round(coalesce(x, 0.0), 6) AS x FROM z LEFT JOIN x USING (story_id, pos, dim)""",
    "known_word_counts": f"WITH {_TOK} SELECT story_id, pos, CAST(sum(n) AS BIGINT) AS n FROM tc WHERE length(t) > 1 GROUP BY ALL",
    "hashed_vectors": f"""WITH {_TOK}
SELECT story_id, pos, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS INTEGER) AS dim, CAST(sum(n) AS DOUBLE) AS n FROM tc GROUP BY ALL""",
    "encoded_distinct": f"""WITH {_TOK},
b AS (SELECT story_id, pos, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS dim, sum(n) AS n FROM tc GROUP BY ALL)
SELECT story_id, pos, round(coalesce(sqrt(sum(n * n)), 0.0), 6) AS norm FROM tk LEFT JOIN b USING (story_id, pos) GROUP BY ALL""",
    "paragraph_vector": f"""WITH {_SV}
SELECT story_id, CAST(k - 1 AS INTEGER) AS dim, round(avg(vec[k]), 6) AS x FROM sv, range(1, 65) g(k) GROUP BY ALL""",
    "consecutive_distance": f"WITH {_STEP} SELECT story_id, step, round(d, 6) AS d FROM st",
    "consecutive_summary": f"WITH {_STEP} SELECT story_id, {_FIVE} FROM st GROUP BY story_id",
    "pairwise_summary": f"WITH {_PAIR} SELECT story_id, count(*) AS n_pairs, {_FIVE} FROM pr GROUP BY story_id " + _LONE.format(k="story_id", t="sv"),
    "pairwise_mean_linear": f"""WITH {_PAIR}, n AS (SELECT story_id, count(*) AS n FROM sv GROUP BY story_id)
SELECT story_id, n, round(coalesce(avg(d), 1.0), 6) AS mean FROM n LEFT JOIN pr USING (story_id) GROUP BY ALL""",
    "paraphrase_vs_rest": f"""WITH {_PAIR}, n AS (SELECT story_id, count(*) AS n FROM sv GROUP BY story_id),
x AS (SELECT story_id, n - 1 AS dst, story_id % (n - 1) AS src FROM n WHERE n > 2)
SELECT story_id, round(max(d) FILTER (i = src AND j = dst) - avg(d) FILTER (j <> dst), 6) AS para_vs_others
FROM x JOIN pr USING (story_id) GROUP BY story_id""",
    "distance_summary_wide": _wide(),
    "jaccard_consecutive": f"WITH {_JPAIR} SELECT story_id, i AS step, round(d, 6) AS d FROM jd WHERE j = i + 1",
    "jaccard_summary": f"WITH {_JPAIR} SELECT story_id, count(*) AS n_pairs, {_FIVE} FROM jd GROUP BY story_id " + _LONE.format(k="story_id", t="tk"),
    "paraphrase_vs_rest_jaccard": f"""WITH {_JPAIR}, n AS (SELECT story_id, count(*) AS n FROM tk GROUP BY story_id),
x AS (SELECT story_id, n - 1 AS dst, story_id % (n - 1) AS src FROM n WHERE n > 2)
SELECT story_id, round(max(d) FILTER (i = src AND j = dst) - avg(d) FILTER (i <> src AND j <> src AND j <> dst), 6) AS para_vs_others
FROM x JOIN jd USING (story_id) GROUP BY story_id""",
    "wmd_relaxed_consecutive": f"""WITH {_TOK}, {_VOC},
w AS (SELECT story_id, pos, t, vec, n / sum(n) OVER (PARTITION BY story_id, pos) AS w FROM tc JOIN vocab USING (t)),
cost AS (SELECT a.story_id, a.pos, a.t AS ta, b.t AS tb, a.w AS wa, b.w AS wb,
         sqrt(greatest(2 - 2 * list_cosine_similarity(a.vec, b.vec), 0)) AS c
         FROM w a JOIN w b ON a.story_id = b.story_id AND b.pos = a.pos + 1),
l AS (SELECT story_id, pos, sum(m * wa) AS x FROM (SELECT story_id, pos, ta, wa, min(c) AS m FROM cost GROUP BY ALL) GROUP BY ALL),
r AS (SELECT story_id, pos, sum(m * wb) AS y FROM (SELECT story_id, pos, tb, wb, min(c) AS m FROM cost GROUP BY ALL) GROUP BY ALL),
st AS (SELECT a.story_id, a.pos AS step FROM tk a JOIN tk b ON a.story_id = b.story_id AND b.pos = a.pos + 1)
SELECT st.story_id, step, round(greatest(x, y) / 2, 6) AS d FROM st
LEFT JOIN l ON l.story_id = st.story_id AND l.pos = step LEFT JOIN r ON r.story_id = st.story_id AND r.pos = step""",
    "narrative_speed": f"""WITH {_STEP},
m AS (SELECT *, count(*) OVER (PARTITION BY story_id) AS m, lead(d) OVER w AS nx FROM st WINDOW w AS (PARTITION BY story_id ORDER BY step)),
g AS (SELECT story_id, m, CASE WHEN step = 0 THEN nx WHEN step = m - 1 THEN d ELSE (d + nx) / 2 END AS g FROM m),
t AS (SELECT story_id, m, sum(abs(g)) / max(m) AS v FROM g GROUP BY story_id, m)
SELECT story_id, m + 1 AS n, round(CASE WHEN m <= 2 THEN 0 ELSE 2 * v END, 6) AS speed,
  round(CASE WHEN m <= 2 THEN 0 ELSE 2 * v / (m + 1) END, 6) AS speed_norm, round(v, 6) AS plain_speed FROM t""",
    "trajectory_curve": f"WITH {_STEP} SELECT story_id, step, round(d, 6) AS d, round(sum(d) OVER (PARTITION BY story_id ORDER BY step), 6) AS path FROM st",
    "trajectory_length": f"""WITH {_STEP}, n AS (SELECT story_id, count(*) AS n FROM sv GROUP BY ALL)
SELECT story_id, round(coalesce(sum(d), 0.0) / n, 6) AS trajectory_score FROM n LEFT JOIN st USING (story_id) GROUP BY story_id, n""",
    "silhouette_given_labels": _SIL + "SELECT story_id, n, n_labels, round(s, 6) AS silhouette FROM fin",
    "cluster_scores_given_labels": _SIL + """SELECT story_id, round(CASE WHEN s IS NULL THEN 0 ELSE n_labels / n END, 6) AS cluster_density,
round(CASE WHEN s IS NULL THEN 0 ELSE 1 - s END, 6) AS reverse_silhouette FROM fin""",
    "cluster_members": "SELECT conv_id AS story_id, turn AS pos, CAST(length(text) % 3 AS INTEGER) AS label, text AS sentence FROM conversations",
}

"""Registered queries: sentences, text clean-up, codes, predicates and the cleaning funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import predicates as P
from ..functions import text as T
from ..operators import cleaning as C
from ..operators.compose import lemmatise
from . import sqltext as S
from . import views as V

c = F.col


def sentence_split(spark, d):
    return V.documents(spark, d).select("doc_id", F.posexplode(T.sentences(c("text"))).alias("pos", "sentence"))


def sentence_count(spark, d):
    return V.documents(spark, d).select("doc_id", F.size(T.sentences(c("text"))).alias("num_sentences"))


def text_normalise(spark, d):
    t = c("text")
    return V.documents(spark, d).select(
        "doc_id",
        T.squeeze_periods(t).alias("squeezed"),
        T.space_after_stop(t).alias("spaced"),
        T.flatten_breaks(t).alias("flat"),
        T.drop_punctuation(t).alias("bare"),
    )


def respaced_text(spark, d):
    return V.documents(spark, d).select("doc_id", T.respaced_sentences(c("text")).alias("respaced"))


def tidy_generated(spark, d):
    return V.documents(spark, d).select("doc_id", T.tidy_generated(c("text")).alias("tidy"))


def period_pieces(spark, d):
    return V.documents(spark, d).select("doc_id", F.posexplode(T.period_pieces(c("text"))).alias("pos", "piece"))


def token_counts(spark, d):
    return (
        V.turn_tokens(spark, d)
        .select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def lemma_tokens(spark, d):
    """Tokens looked up in a lemma table (here: plural forms of known tokens), else unchanged."""
    toks = V.turn_tokens(spark, d).select("story_id", "pos", F.posexplode("tokens").alias("i", "token"))
    words = toks.select("token").distinct()
    lemmas = words.where("token like '%s' and length(token) > 3").select(
        "token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma")
    )
    return lemmatise(toks, lemmas).groupBy("lemma").agg(
        F.count(F.lit(1)).alias("n")
    )


def simulation_labels(spark, d):
    """Temperature bands, paraphrase names, combined labels, their inverse and treatment codes."""
    temp = (c("n_chars") / 1000.0)
    kind = F.element_at(F.array(*[F.lit(k) for k in L.KIND_CODES]), ((c("doc_id") % 4) + 1).cast("int"))
    base = V.documents(spark, d).select("doc_id", temp.alias("temperature"), kind.alias("kind"))
    base = base.withColumns(
        {
            "kind_code": L.kind_code(c("kind")),
            "band_code": L.band_code(c("temperature")),
            "band": L.band_name(c("temperature")),
            "display_band": L.band_code(c("temperature"), L.DISPLAY_BAND_CUTS),
        }
    )
    base = base.withColumn("para", L.paraphrase_name((c("kind_code") != 0).cast("int")))
    base = base.withColumn("label", L.combined_label(c("band"), c("para")))
    return base.select(
        "doc_id", "kind_code", "band_code", "band", "display_band", "para", "label",
        L.label_band(c("label")).alias("label_band"),
        L.label_paraphrase(c("label")).alias("label_para"),
        L.treatment(c("label")).alias("treatment"),
    )


def category_codes(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "source")
    coded = C.category_codes(C.category_codes(docs, "source", "source_code"), "lang", "lang_code")
    return coded.select("doc_id", "source_code", "lang_code")


LANG_CODES = {"en": 0, "fr": 1, "de": 2}
LANG_NAMES = {"en": "English", "fr": "French"}


def relabelled(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id",
        L.lookup(c("lang"), LANG_CODES).alias("code"),
        L.lookup(c("lang"), LANG_NAMES, keep_unknown=True).alias("name"),
    )


def parsed_index(spark, d):
    """Position pairs written as text, parsed back; broken texts give an empty list."""
    i, n = c("doc_id") % 7, c("n_chars") % 11
    raw = (
        F.when(c("doc_id") % 5 == 0, F.format_string("(%d, %d)", i, n))
        .when(c("doc_id") % 5 == 1, F.format_string("[%d, %d]", i, n))
        .when(c("doc_id") % 5 == 2, F.format_string("%d", i))
        .when(c("doc_id") % 5 == 3, F.lit("[]"))
        .otherwise(c("lang"))
    )
    idx = V.table(spark, d, "documents").select("doc_id", T.index_list(raw).alias("idx"))
    return idx.select(
        "doc_id",
        F.size("idx").alias("n"),
        F.try_element_at("idx", F.lit(1)).alias("src"),
        F.try_element_at("idx", F.lit(2)).alias("dst"),
    )


def pii_flags(spark, d):
    t = c("text")
    return V.documents(spark, d).select(
        "doc_id",
        P.has_phone(t).alias("phone"),
        P.has_address(t).alias("address"),
        P.has_mail(t).alias("mail"),
        P.looks_like_list(t).alias("listed"),
        P.has_link(t).alias("link"),
    )


def _pair(df):
    """Attach the deterministic paraphrase index to stories of three or more sentences."""
    n = F.size("sentences")
    src, dst = V.paraphrase_index(n.cast("bigint"), c("story_id"))
    return df.withColumn(
        "idx", F.when(n >= 3, F.array(src, dst).cast("array<int>")).otherwise(F.array().cast("array<int>"))
    )


def flagged(spark, d):
    base = T.with_sentences(C.drop_linked(V.stories(spark, d)), "altered_text")
    return C.with_flags(_pair(base), index="idx")


def clean_funnel(spark, d):
    return C.funnel(flagged(spark, d), ["en", "fr", "de"])


def cleaned_corpus(spark, d):
    return C.keep_clean(flagged(spark, d), ["en", "fr", "de"]).select("story_id", "num_sentences", "prompt")


def lexical_repetition(spark, d):
    """A per-story score, flagged against the median of the positive scores."""
    score = ((c("n_chars") % 97) - 30).cast("double")
    docs = V.table(spark, d, "documents").select("doc_id", score.alias("score"))
    return C.lexical_repetition(docs, "score").select("doc_id", F.col("has_lexical_repetition").alias("flag"))


def finite_rows(spark, d):
    l = V.table(spark, d, "lineitem")
    ratio = F.when(c("l_tax") == 0, F.lit(float("inf"))).otherwise(c("l_discount") / F.nullif(c("l_tax"), F.lit(0.0)))
    kept = C.without_infinite(l.select("l_returnflag", ratio.alias("ratio")), ["ratio"])
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(T.safe_ratio(c("ratio"), F.lit(2.0))), 6).alias("half_ratio")
    )


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, sentence_count, text_normalise, respaced_text, tidy_generated, period_pieces, token_counts,
        lemma_tokens, simulation_labels, category_codes, relabelled, parsed_index, pii_flags, clean_funnel,
        cleaned_corpus, lexical_repetition, finite_rows,
    )
}

_PUNCT = S.q(T.PUNCTUATION)

_FLAGGED = f"""
WITH {S.sentences_cte('sent', "(SELECT * FROM documents WHERE NOT regexp_matches(text, 'www|http'))")},
base AS (
  SELECT d.doc_id AS story_id, d.text, d.lang AS prompt, s.s, len(s.s) AS n,
         CASE WHEN len(s.s) >= 3 THEN d.doc_id % (len(s.s) - 1) END AS src
  FROM sent s JOIN documents d USING (doc_id)),
flags AS (
  SELECT *, n > 5 AND n < 20 AS k1,
    NOT regexp_matches(text, {S.q(P.PHONE)}) AS k2,
    NOT regexp_matches(text, {S.q(S.ADDRESS_SQL)}) AS k3,
    NOT regexp_matches(text, {S.q(S.MAIL_SQL)}) AS k4,
    NOT regexp_matches(text, {S.q(P.LIST_MARK)}) AS k5,
    NOT coalesce(len(string_split(CASE WHEN src = 0 THEN s[-1] ELSE s[src] END, ' ')) < 5, FALSE) AS k6,
    NOT coalesce(src >= n - 2, FALSE) AS k7,
    prompt IN ('en', 'fr', 'de') AS k8
  FROM base)
"""

ORACLES = {
    "sentence_split": f"""
WITH {S.sentences_cte()}
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sent)""",
    "sentence_count": f"WITH {S.sentences_cte()} SELECT doc_id, CAST(len(s) AS INTEGER) AS num_sentences FROM sent",
    "text_normalise": rf"""
SELECT doc_id, regexp_replace(text, '\.+', '.', 'g') AS squeezed,
  regexp_replace(text, '([.!?])(\S)', '\1 \2', 'g') AS spaced,
  replace(replace(text, chr(10), ' '), chr(9), ' ') AS flat,
  regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g') AS bare
FROM documents""",
    "respaced_text": rf"""
WITH r AS (SELECT doc_id, regexp_replace(text, '([.!?])(\S)', '\1 \2', 'g') AS text FROM documents),
{S.sentences_cte('sent', 'r')}
SELECT doc_id, array_to_string(s, ' ') AS respaced FROM sent""",
    "tidy_generated": rf"""
WITH {S.sentences_cte()},
k AS (SELECT doc_id, CASE WHEN len(s) = 0 OR suffix(s[-1], '.') THEN s ELSE s[:-2] END AS s FROM sent)
SELECT doc_id, coalesce(replace(array_to_string(list_transform(s, lambda x: regexp_replace(x, '[^a-zA-Z0-9\s]', '', 'g')), '.'), chr(10), ' '), '') AS tidy
FROM k""",
    "period_pieces": """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS piece
FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents))""",
    "token_counts": f"""
SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS token FROM conversations) GROUP BY token""",
    "lemma_tokens": f"""
SELECT CASE WHEN suffix(token, 's') AND length(token) > 3 THEN substr(token, 1, length(token) - 1) ELSE token END AS lemma, count(*) AS n
FROM (SELECT unnest({S.tokens('text')}) AS token FROM conversations) GROUP BY 1""",
    "simulation_labels": """
WITH a AS (SELECT doc_id, n_chars / 1000.0 AS t, doc_id % 4 AS k FROM documents),
b AS (SELECT *, CASE WHEN t < 2 THEN 'low_temperature' WHEN t < 4 THEN 'medium_temperature' ELSE 'high_temperature' END AS band,
  CASE WHEN k < 2 THEN 'no_paraphrase' ELSE 'paraphrase' END AS para,
  CASE WHEN k < 2 THEN 0 ELSE k - 1 END AS kc FROM a),
l AS (SELECT *, band || '_with_' || para AS label FROM b)
SELECT doc_id, CAST(kc AS INTEGER) AS kind_code,
  CAST(CASE WHEN t < 2 THEN 0 WHEN t < 4 THEN 1 ELSE 2 END AS INTEGER) AS band_code, band,
  CAST(CASE WHEN t < 2 THEN 0 WHEN t < 3 THEN 1 ELSE 2 END AS INTEGER) AS display_band, para, label,
  split_part(band, '_', 1) AS label_band, 'with_' || para AS label_para,
  CAST(CASE WHEN label = 'low_temperature_with_no_paraphrase' THEN 0
       WHEN para = 'paraphrase' AND band <> 'low_temperature' THEN 1 ELSE -1 END AS INTEGER) AS treatment
FROM l""",
    "category_codes": """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_code,
  CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code FROM documents""",
    "relabelled": """
SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS INTEGER) AS code,
  CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS name FROM documents""",
    "parsed_index": """
SELECT doc_id, CAST(CASE WHEN doc_id % 5 < 2 THEN 2 ELSE 0 END AS INTEGER) AS n,
  CAST(CASE WHEN doc_id % 5 < 2 THEN doc_id % 7 END AS INTEGER) AS src,
  CAST(CASE WHEN doc_id % 5 < 2 THEN n_chars % 11 END AS INTEGER) AS dst FROM documents""",
    "pii_flags": f"""
SELECT doc_id, regexp_matches(text, {S.q(P.PHONE)}) AS phone, regexp_matches(text, {S.q(S.ADDRESS_SQL)}) AS address,
  regexp_matches(text, {S.q(S.MAIL_SQL)}) AS mail, regexp_matches(text, {S.q(P.LIST_MARK)}) AS listed,
  regexp_matches(text, 'www|http') AS link
FROM documents""",
    "clean_funnel": _FLAGGED + """,
n AS (SELECT count(*) AS s0, count(*) FILTER (k1) AS s1, count(*) FILTER (k1 AND k2) AS s2,
  count(*) FILTER (k1 AND k2 AND k3) AS s3, count(*) FILTER (k1 AND k2 AND k3 AND k4) AS s4,
  count(*) FILTER (k1 AND k2 AND k3 AND k4 AND k5) AS s5, count(*) FILTER (k1 AND k2 AND k3 AND k4 AND k5 AND k6) AS s6,
  count(*) FILTER (k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND k7) AS s7,
  count(*) FILTER (k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND k7 AND k8) AS s8 FROM flags)
SELECT CAST(i AS INTEGER) AS step_no,
  (['start','sentence_window','phone','address','mail','list','short_paraphrase','paraphrase_at_end','prompt'])[i + 1] AS step,
  ([s0,s1,s2,s3,s4,s5,s6,s7,s8])[i + 1] AS n_left
FROM n, range(0, 9) r(i)""",
    "cleaned_corpus": _FLAGGED + """
SELECT story_id, CAST(n AS INTEGER) AS num_sentences, prompt FROM flags WHERE k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND k7 AND k8""",
    "lexical_repetition": """
WITH a AS (SELECT doc_id, CAST(n_chars % 97 - 30 AS DOUBLE) AS score FROM documents)
SELECT doc_id, CAST(score > (SELECT quantile_cont(score, 0.5) FROM a WHERE score > 0) AS INTEGER) AS flag FROM a""",
    "finite_rows": """
SELECT l_returnflag, count(*) AS n, round(avg(l_discount / l_tax / 2.0), 6) AS half_ratio
FROM lineitem WHERE l_tax <> 0 GROUP BY l_returnflag""",
}

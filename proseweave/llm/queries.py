"""The registered queries of this package: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import centroids, covertree, decontaminate, language, licenses, mixing, pii, quality, resampling, secret_scan, simhash, suffixes, url_filter


def _remainder(key: str, by: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % by


def op1_covertree(spark: SparkSession, d: str) -> DataFrame:
    found = covertree.linked(table(spark, d, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.detect(table(spark, d, "documents"), pii.train(pii.labelled_table(spark)))


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_factor", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"),
    )


def op4_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return decontaminate.contamination(found).drop("spans", "item_ids")


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, d, "labels"), _remainder("doc_id", 3) != 1)
    out = quality.score(documents, model)
    return out.select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents")).drop("matches").withColumn("score", F.round("score", 9))


def op8_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, d, "documents")).drop("kept_text")


def op9_language(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.train(documents, _remainder("doc_id", 4) != 2)
    out = language.identify(documents, model)
    return out.select("doc_id", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op11_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.detect(table(spark, d, "documents"), secret_scan.train(secret_scan.labelled_table(spark)))


def op12_resampling(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    model = resampling.train(documents, table(spark, d, "benchmark"))
    return resampling.resample(documents, model).drop("n_words")


def op13_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids.assignments(table(spark, d, "embeddings").select("vec_id", "embedding"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


def _op3_sql() -> str:
    topic = " ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{cue}{chr(39)})' for cue in cues)} THEN '{name}'" for name, cues in mixing.TOPICS)
    out = f"""WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CASE {topic} ELSE 'prose' END AS topic,
  len(regexp_extract_all(x, '[^ \\t\\n\\x0b\\x0c\\r]+'))::BIGINT AS n_tokens FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY ALL), total AS (SELECT sum(t) AS n FROM c)"""
    for dim in mixing.DIMENSIONS:
        out += f""",
p_{dim} AS (SELECT {dim}, pow(sum(t), {mixing.TEMPER}) AS p FROM c GROUP BY {dim})"""
    shares = ", ".join(f"p_{dim}.p / (SELECT sum(p) FROM p_{dim}) AS to_{dim}" for dim in mixing.DIMENSIONS)
    joins = " ".join(f"JOIN p_{dim} USING ({dim})" for dim in mixing.DIMENSIONS)
    out += f""",
c1 AS (SELECT source, lang, topic, t, {shares} FROM c {joins})"""

    def level(name, rows, by, avail, weight, total, ties):
        down, up = ", ".join(ties), ", ".join(f"{t} DESC" for t in ties)
        part = f"PARTITION BY {by} " if by else ""
        ratio = f"CASE WHEN {avail} > 0 THEN {weight} / {avail} END"
        return f""",
{name} AS (SELECT * EXCLUDE (l), greatest(0, coalesce(max(l) OVER ({part}), 0)) AS x FROM (SELECT * EXCLUDE (b, r), CASE WHEN r > 0 THEN ({total} - coalesce(b, 0)) / r END AS l FROM (SELECT *,
  sum({avail}) OVER ({part}ORDER BY {ratio} DESC NULLS LAST, {down} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  sum({weight}) OVER ({part}ORDER BY {ratio} ASC NULLS FIRST, {up} ROWS UNBOUNDED PRECEDING) AS r FROM {rows})))"""

    for dim in mixing.DIMENSIONS:
        out += level(f"l_{dim}", f"(SELECT {dim}, sum(t) AS a, CASE WHEN sum(t) > 0 THEN max(to_{dim}) ELSE 0 END AS s FROM c1 GROUP BY {dim})", "", "a", "s", f"{mixing.BUDGET} * (SELECT n FROM total)", [dim])
    reach = ", ".join(f"least(l_{dim}.a, l_{dim}.s * l_{dim}.x) AS in_{dim}" for dim in mixing.DIMENSIONS)
    out += f""",
f0 AS MATERIALIZED (SELECT source, lang, topic, t, CASE WHEN t > 0 THEN 1.0::DOUBLE ELSE 0 END AS factor, {reach} FROM c1 {" ".join(f"JOIN l_{dim} USING ({dim})" for dim in mixing.DIMENSIONS)})"""
    k = 0
    for _ in range(mixing.SWEEPS):
        for dim in mixing.DIMENSIONS:
            out += level(f"x{k}", f"f{k}", dim, "t", "(t * factor)", f"in_{dim}", mixing.DIMENSIONS)
            out += f""",
f{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (x) REPLACE (factor * x AS factor) FROM x{k})"""
            k += 1
    return out + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(factor, 6) AS weight, round(least(1, factor), 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < least(1, factor) AS kept
FROM d JOIN f{k} USING (source, lang, topic)"""


_OP4 = f"""WITH dw AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
bw AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _op7_sql() -> str:
    rows = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, string_split('{' '.join(t.words)}', ' '), {t.key_at[0]}, {t.key_at[1]})" for k, t in enumerate(licenses.TEMPLATES))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql('text')} AS w FROM documents),
t(tid, label, base, words, key_at, key_len) AS (VALUES {rows}),
v AS (SELECT tid, label, base, key_at, key_len, unnest(words) AS word, unnest(range(len(words))) AS i FROM t),
p AS (SELECT * FROM (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d) WHERE word IN (SELECT word FROM v)),
n AS (SELECT count(*) AS n FROM d), df AS (SELECT word, count(DISTINCT rid) AS c FROM p GROUP BY word),
tw AS (SELECT *, ln((n + 1) / (coalesce(c, 0) + 0.5)) AS idf FROM v LEFT JOIN df USING (word), n),
r AS (SELECT *, sum(idf) OVER (PARTITION BY tid) AS total FROM tw),
m AS (SELECT rid, tid, pos - i AS start, any_value(label) AS label, any_value(base) AS base, least(1, sum(idf) / any_value(total)) AS share FROM p JOIN r USING (word) GROUP BY rid, tid, pos - i
  HAVING count(*) FILTER (i >= key_at AND i < key_at + key_len) = any_value(key_len) AND sum(idf) / any_value(total) >= {licenses.LEAST_SHARE}),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0)::DOUBLE, 9) AS score FROM d LEFT JOIN g USING (rid)"""


def _term_sql(terms) -> str:
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)


def _op10_sql() -> str:
    rest = "substr(url, strpos(url, '://') + 3)"
    cases = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in cases)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in cases)
    return f"""WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
  CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract({rest}, '^[^?#]*') ELSE '' END AS r FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(r, '^[^/]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '/.*$', 0, 's') AS path FROM a),
c AS (SELECT *, CASE {rule} END AS rule, ({_term_sql(url_filter.STRICT)})::BIGINT AS n_strict, ({_term_sql([t for t, _ in url_filter.SOFT])})::BIGINT AS n_soft FROM b)
SELECT page_id, host, path, rule, CASE {verdict} WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM c"""


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_OP12 = f"""WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: {_STEP}, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql('text')} AS w FROM documents),
f AS (SELECT rid, unnest(w) AS w FROM d), g AS (SELECT unnest({_words_sql('text')}) AS w FROM benchmark),
u AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM g)),
v AS (SELECT w, xor(list_reduce(list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)
  % {resampling.BUCKETS} AS b FROM u, crc),
s AS (SELECT b, count(*) AS s FROM f JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN v USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS s_all, (SELECT count(*) FROM g)::DOUBLE AS t_all),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + {resampling.BUCKETS})) / ((s + 1.0::DOUBLE) * (t_all + {resampling.BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), n),
m AS (SELECT rid, sum(gain) AS total, count(*) AS k FROM f JOIN v USING (w) JOIN gain USING (b) GROUP BY rid),
e AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / k), 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN m USING (rid)),
r AS (SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= {resampling.LEAST_WORDS} AS enough FROM e)
SELECT doc_id, n_features, weight, score,
  CASE WHEN enough AND row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST) <= (SELECT count(*) * {resampling.PERCENT} // 100 FROM r WHERE enough)
  THEN row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST) END AS rank FROM r"""


def _op13_sql() -> str:
    near = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    out = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('{centroids.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM e ORDER BY h, v LIMIT {centroids.CLUSTERS}))"""
    for r in range(centroids.ROUNDS + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT rid, (min((d, c)))[1] AS d, (min((d, c)))[2] AS c FROM (SELECT rid, c, {near} AS d FROM e AS v, c{r} AS c) GROUP BY rid)"""
        if r < centroids.ROUNDS:
            out += f""",
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m, v) AS v FROM c{r} LEFT JOIN (SELECT c, list(q ORDER BY i) AS m FROM (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS q
  FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r} JOIN e USING (rid)) GROUP BY c, i)) GROUP BY c) USING (c))"""
    r = centroids.ROUNDS
    return out + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{r} AS a JOIN e USING (rid) JOIN c{r} AS c ON a.c = c.c"""


QUERIES = {
    "op1_covertree": op1_covertree,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_suffixes": op8_suffixes,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
    "op11_secrets": op11_secrets,
    "op12_resampling": op12_resampling,
    "op13_centroids": op13_centroids,
}
_OP1 = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(b) AS b FROM c GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN m ON vec_id = m.a LEFT JOIN n ON vec_id = n.a"""


ORACLES = {
    "op1_covertree": _OP1,
    "op3_mixing": _op3_sql(),
    "op7_licenses": _op7_sql(),
    "op4_decontaminate": _OP4, "op10_url_filter": _op10_sql(), "op12_resampling": _OP12, "op13_centroids": _op13_sql()}

"""Registered queries: small table steps, compositions, and round trips through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compose as CO
from ..operators import encode as E
from ..operators import tables as TB
from ..session import ensure_checkpoint_dir
from ..sources import corpora as SRC
from . import sqltext as S
from . import views as V

c = F.col


def fill_missing(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.when(c("value") < 10, F.lit(float("nan"))).when(c("value") > 20, c("value")).alias("value"))
    return CO.fill_missing(e, ["value"])


def complete_rows(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.when(c("o_custkey") % 3 > 0, c("o_custkey")).alias("cust"), F.when(c("o_orderkey") % 2 > 0, c("o_totalprice")).alias("price"))
    return CO.complete_rows(o, ["cust", "price"])


def several_vectors(spark, d):
    v = V.story_vectors(spark, d).select("story_id", "pos", F.when((c("pos") < 1) | (c("story_id") % 2 == 0), c("vec")).alias("vec"))
    return CO.several_vectors(v).select("story_id", "pos")


def length_normalised(spark, d):
    s = V.documents(spark, d).select("doc_id", c("n_chars").cast("double").alias("score"), (c("doc_id") % 7).alias("n"))
    return CO.length_normalised(s, "score", "n", "share").select("doc_id", F.round("share", 6).alias("share"))


def largest_orders(spark, d):
    return TB.top_by(V.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15, "o_orderkey")


def shuffled_customers(spark, d):
    """A full shuffle keeps every row once."""
    return TB.shuffled(V.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")


def tallied_struct(spark, d):
    """A struct column of counts spread to plain columns."""
    o = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")).alias("s"))
    return TB.widen_struct(o, "s")


def _hashed(dims: int) -> E.Encoder:
    """Encoder of hashed token counts, the same on every machine."""
    return lambda df: df.select("sentence", E.hashed_bag(T.word_tokens(c("sentence")), dims).alias("vec"))


def sentence_features(spark, d):
    """Documents of any length: split, count, keep more than two sentences, encode, summarise."""
    stories = V.stories(spark, d)
    out = CO.sentence_features(stories, {"hashed": _hashed(16)})
    keep = ["hashed_consecutive_cosine_sentences_similarity_mean", "hashed_consecutive_cosine_sentences_similarity_max", "hashed_all_cosine_sentences_similarity_mean"]
    return out.select("story_id", c("num_sentences").cast("long").alias("num_sentences"), *[F.round(k, 6).alias(k) for k in keep])


def _folder(spark) -> str:
    """A new folder on the storage that all machines share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sources-{uuid.uuid4()}"


def delimited_round_trip(spark, d):
    """A table written as tab-separated text with a header and read back through its schema."""
    own = V.table(spark, d, "supplier").select("s_suppkey", "s_name", c("s_acctbal").cast("double").alias("s_acctbal"))
    path = _folder(spark)
    SRC.write_delimited(own, path, "\t")
    return SRC.read_delimited(spark, path, own.schema, "\t", line_breaks=False)


def quoted_round_trip(spark, d):
    """Texts with line breaks, separators and quotes of their own, written as delimited text and read back split by split."""
    path = _folder(spark)
    texts = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit('<"\n'), F.coalesce("text", F.lit("")), F.lit(',\n\n">')).alias("text"))
    SRC.write_delimited(texts, path)
    return SRC.read_delimited(spark, path, texts.schema, ",").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def stage_round_trip(spark, d):
    """A stage table, partitioned by a column, stored and read back."""
    own = V.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return SRC.stage(own, _folder(spark), ["n_regionkey"]).select("n_nationkey", "n_name", c("n_regionkey").cast(own.schema["n_regionkey"].dataType).alias("n_regionkey"))


def stored_once(spark, d):
    """A second write of the same run leaves the first as it is."""
    path = _folder(spark)
    own = V.table(spark, d, "region").select("r_regionkey", "r_name")
    SRC.write_once(own, path)
    SRC.write_once(own.limit(0), path)
    return spark.read.parquet(path)


def offline_runs(spark, d):
    runs = SRC.offline_runs(V.documents(spark, d).select("doc_id", F.sha2("text", 256).alias("text")), "base")
    return runs.select("doc_id", "llm_model", "altered_text", "nb_paraphrase_max", "paraphase_type")


QUERIES = {
    f.__name__: f
    for f in (
        fill_missing, complete_rows, several_vectors, length_normalised, largest_orders, shuffled_customers, tallied_struct, sentence_features,
        delimited_round_trip, quoted_round_trip, stage_round_trip, stored_once, offline_runs,
    )
}

_DIMS = 16
_BAG = f"""list_transform(range(0, {_DIMS}), lambda i: len(list_filter(list_transform({S.tokens('x')}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {_DIMS}), lambda s: s = i))::DOUBLE)"""

ORACLES = {
    "fill_missing": "SELECT event_id, CASE WHEN value > 20 THEN value ELSE -1.0::DOUBLE END AS value FROM events",
    "complete_rows": "SELECT o_orderkey, o_custkey AS cust, o_totalprice AS price FROM orders WHERE o_custkey % 3 > 0 AND o_orderkey % 2 > 0",
    "several_vectors": """WITH v AS (SELECT vec_id // 8 AS story_id, vec_id % 8 AS pos FROM embeddings WHERE vec_id % 8 < 1 OR (vec_id // 8) % 2 = 0)
SELECT story_id, pos FROM v WHERE story_id IN (SELECT story_id FROM v GROUP BY story_id HAVING count(*) > 1)""",
    "length_normalised": "SELECT doc_id, round(n_chars::DOUBLE / nullif(doc_id % 7, 0), 6) AS share FROM documents",
    "largest_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "shuffled_customers": "SELECT c_custkey, c_nationkey FROM customer",
    "tallied_struct": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey",
    "sentence_features": f"""WITH {S.sentences_cte()},
r AS (SELECT doc_id AS story_id, len(s) AS n, unnest(s) AS x, unnest(range(0, len(s))) AS pos FROM sent WHERE len(s) > 2),
v AS (SELECT story_id, n, pos, {_BAG} AS e FROM r),
u AS (SELECT story_id, n, pos, e, sqrt(list_inner_product(e, e)) AS l FROM v),
p AS (SELECT a.story_id, a.pos AS i, b.pos AS j, CASE WHEN a.l > 0 AND b.l > 0 THEN 1 - list_inner_product(a.e, b.e) / (a.l * b.l) END AS d FROM u a JOIN u b ON a.story_id = b.story_id AND a.pos < b.pos),
c AS (SELECT story_id, CASE WHEN count(*) = count(d) THEN avg(d) END AS cm, CASE WHEN count(*) = count(d) THEN max(d) END AS cx FROM p WHERE j = i + 1 GROUP BY story_id),
a AS (SELECT story_id, CASE WHEN count(*) = count(d) THEN avg(d) END AS am FROM p GROUP BY story_id)
SELECT story_id, num_sentences, round(cm, 6) AS hashed_consecutive_cosine_sentences_similarity_mean, round(cx, 6) AS hashed_consecutive_cosine_sentences_similarity_max,
  round(am, 6) AS hashed_all_cosine_sentences_similarity_mean FROM (SELECT doc_id AS story_id, len(s)::BIGINT AS num_sentences FROM sent WHERE len(s) > 2) JOIN c USING (story_id) JOIN a USING (story_id)""",
    "delimited_round_trip": "SELECT s_suppkey, s_name, s_acctbal::DOUBLE AS s_acctbal FROM supplier",
    "quoted_round_trip": """SELECT doc_id, sha256('<"' || chr(10) || coalesce(text, '') || ',' || chr(10) || chr(10) || '">') AS text_sha256 FROM documents""",
    "stage_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "stored_once": "SELECT r_regionkey, r_name FROM region",
    "offline_runs": "SELECT doc_id, 'base' AS llm_model, sha256(text) AS altered_text, 0 AS nb_paraphrase_max, 'absent' AS paraphase_type FROM documents",
}

"""Registered queries: corpus construction, composites, table operators, review, syntax."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning as CL
from ..operators import composites as CP
from ..operators import corpus as K
from ..operators import review as R
from ..operators import syntax as X
from ..operators import tables as TB
from ..operators.ordered import melt
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import corpora as SRC
from ..streaming import resumable as RS
from . import sqltext as S
from . import views as V
from .text_queries import _pair

c = F.col
ALPHA, P, Q = 0.7, 0.6, 0.5


def _prompts(spark, d):
    return V.table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("prompt")).distinct()


def simulation_grid(spark, d):
    g = K.simulation_grid(_prompts(spark, d), 200, 1.0, 5.0)
    return g.select("prompt", "sim", F.round("temperature", 6).alias("temperature"), "num_beams")


def drawn_temperatures(spark, d):
    g = K.simulation_grid(_prompts(spark, d), 200, 1.0, 5.0)
    return g.groupBy("num_beams").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("temperature"), 6).alias("mean"), F.round(F.stddev_pop("temperature"), 6).alias("std")
    )


def sweep_grid(spark, d):
    models = V.table(spark, d, "documents").select(c("source").alias("llm_model")).distinct()
    return K.sweep_grid(models, n=[1], p=[0.1], q=[0.9, 0.5, 0.1], alpha=[0.5, 0.7], band=["", "_temperature_2-3", "_temperature_4-5"])


def _split(spark, d):
    return T.with_sentences(V.stories(spark, d), "altered_text")


def heavy_tail_weights(spark, d):
    n = F.size("sentences")
    w = _split(spark, d).select(
        "story_id",
        F.posexplode(F.arrays_zip(K.position_weights(n, ALPHA).alias("a"), K.position_weights(n, ALPHA, True).alias("b"))).alias("i", "w"),
    )
    return w.select("story_id", "i", F.round(c("w.a"), 6).alias("p_distant"), F.round(c("w.b"), 6).alias("p_close"))


def _planned(spark, d):
    return K.plan_insertions(_split(spark, d), P, Q, ALPHA)


def heavy_tail_pick(spark, d):
    return _planned(spark, d).select("story_id", "kind", "src", "dst")


def _echo(sentences):
    """Stand-in paraphraser for the checks."""
    return sentences.select("sentence", F.concat(F.lit("Again: "), F.lower("sentence")).alias("paraphrase"))


def paraphrase_inserted_online(spark, d):
    return K.alter_online(_planned(spark, d), _echo).select("story_id", "kind", "altered_text")


def paraphrase_inserted_offline(spark, d):
    base = T.once(V.documents(spark, d), "_p", T.period_pieces(c("text")))
    i, last = K.offline_position(c("_p"), T.uniform_of(F.lit("off"), c("doc_id")))
    # a few positions outside the text, which must be reported and leave the text alone
    idx = F.when(c("doc_id") % 50 == 0, F.array(last + 1, last)).otherwise(F.array(i, last))
    done = K.alter_offline(base.select("doc_id", "text", idx.alias("index_paraphrase")), _echo)
    return done.select("doc_id", "altered_text", c("error").isNotNull().alias("rejected"))


def paraphrase_flags(spark, d):
    from ..functions import labels as L

    s = _pair(_split(spark, d))
    return s.select(
        "story_id",
        L.is_pair(c("idx")).alias("one"),
        L.first_flag(c("idx")).alias("first"),
        L.consecutive_flag(c("idx")).alias("consecutive"),
        L.short_flag(c("idx"), c("sentences")).alias("short"),
        L.end_flag(c("idx"), F.size("sentences")).alias("at_end"),
    )


def control_corpus(spark, d):
    runs = _pair(_split(spark, d)).withColumnRenamed("idx", "clean_paraphrase_index")
    return K.control_corpus(runs, ["story_id", "prompt"], "sentences")


def aggregated_corpus(spark, d):
    kinds = F.element_at(F.array(F.lit("absent"), F.lit("[]"), F.lit("['close']"), F.lit("['distant']")), (c("story_id") % 4 + 1).cast("int"))
    idx = F.when(c("story_id") % 4 < 2, F.lit("[]")).otherwise(F.format_string("(%d, %d)", c("story_id") % 5, c("story_id") % 5 + c("story_id") % 3))
    runs = V.stories(spark, d).withColumns({"paraphase_type": kinds, "index_paraphrase": idx})
    return K.aggregate_corpora(runs).select(
        "story_id", "clean_paraphase_type", F.size("clean_paraphrase_index").alias("n_idx"), "one_paraphrase", "first_paraphrase", "consecutive_paraphrase"
    )


def enriched_corpus(spark, d):
    """Altered texts with their controls and outside stories, sentence count per provenance."""
    agg = _pair(_split(spark, d)).withColumnRenamed("idx", "clean_paraphrase_index").withColumn("clean_paraphase_type", F.lit(1))
    # read twice, as it is and without its paraphrases: the texts are split once
    agg = cut_lineage(agg.select("story_id", "prompt", "sentences", "clean_paraphrase_index", "clean_paraphase_type"))
    control = K.control_corpus(agg, ["story_id", "prompt"], "sentences")
    other = V.table(spark, d, "benchmark").select(c("item_id").alias("story_id"), c("text").alias("altered_text"))
    e = K.enrich(agg, control, other, low=2, high=20, sentences="sentences")
    return e.groupBy("source", "had_paraphrase", "clean_paraphase_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_sentences").alias("sentences"), F.count("prompt").alias("with_prompt")
    )


def labelled_corpus(spark, d):
    docs = V.table(spark, d, "documents").select(
        "doc_id", (c("n_chars") / 1000.0).alias("temperature"), (c("doc_id") % 3).cast("int").alias("clean_paraphase_type")
    )
    lab = CL.category_codes(K.add_labels(docs, row_id="doc_id"), "combined_label", "cat_label")
    return lab.select("doc_id", "temperature_enc", "paraphrase_enc", "combined_label", "cat_label", F.round("random", 9).alias("random"))


def five_part_story(spark, d):
    """Five sentence columns joined into a text; a missing part gives a missing text."""
    part = lambda i: F.get(c("sentences"), F.lit(i))
    s = _split(spark, d).select("story_id", *[part(i).alias(f"sentence{i + 1}") for i in range(5)])
    return SRC.join_five(s).select("story_id", "text")


def effective_text(spark, d):
    half = V.documents(spark, d).select("doc_id", F.when(c("doc_id") % 2 == 0, c("text")).alias("text"), F.upper("lang").alias("altered_text"))
    return half.select("doc_id", T.effective_text(c("text"), c("altered_text")).alias("effective"))


def marked_text(spark, d):
    first = F.get(T.sentences(c("text")), F.lit(0))
    return V.documents(spark, d).select("doc_id", T.highlight(c("text"), first).alias("marked"))


def repaired_rows(spark, d):
    """Lines of eight tab fields kept, others dropped; the marker is deleted from the last field."""
    line = F.concat_ws(
        "\t", "lang", "source", "doc_id", "n_chars", F.lit("4"), F.lit("(1, 2)"), F.lit("['close']"),
        F.concat(F.translate("text", "\t\n\r", "   "), F.lit("endoftextIllustration")),
    )
    broken = F.when(c("doc_id") % 10 == 3, F.concat(line, F.lit("\textra"))).otherwise(line)
    lines = V.table(spark, d, "documents").select(broken.alias("value"))
    return SRC.repair_lines(lines)


def row_composites(spark, d):
    l = V.features(spark, d)
    cols = V.FEATURES
    st = CP.group_stats(cols, "mean", "std", "ci")
    return l.select("l_orderkey", "l_linenumber", *[F.round(v, 4).alias(k) for k, v in st.items()])


def density_composites(spark, d):
    """All composites over a wide feature table whose columns carry the contract names, summed per bucket
    (an average of short decimals can fall exactly on a rounding tie, a sum cannot)."""
    l = V.spread(V.table(spark, d, "lineitem"), "l_orderkey")
    named = {}
    for k, m in enumerate(("w2v", "glove", "fast_text", "sentence_sim")):
        for scope in ("all", "consecutive"):
            named[f"{m}_{scope}_cosine_sentences_similarity_mean"] = c("l_discount") * (k + 1) + (0.1 if scope == "all" else 0.2)
            named[f"{m}_{scope}_cosine_sentences_similarity_std"] = c("l_tax") * (k + 2)
            if m != "sentence_sim":
                named[f"{m}_{scope}_wmd_sentences_similarity_mean"] = c("l_quantity") / (k + 10.0)
                named[f"{m}_{scope}_wmd_sentences_similarity_std"] = c("l_tax") / (k + 1.0)
    for k, name in enumerate(dict.fromkeys(x for g in CP.GROUPS.values() for x in g)):
        named[name] = c("l_discount") * (k + 1) / 10.0 + c("l_tax") * (k % 3)
    wide = l.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in named.items()])
    out = CP.add_composites(wide)
    new = [x for x in out.columns if x not in wide.columns]
    return out.groupBy((c("l_orderkey") % 50).alias("bucket")).agg(*[F.round(F.sum(c(x).cast("double")), 6).alias(x) for x in sorted(new)])


def composites_long(spark, d):
    l = V.features(spark, d)
    wide = l.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in (CP.group_stats(["l_discount", "l_tax"], "rate", None, "rate_ci") | CP.group_stats(["l_quantity", "l_discount"], "size", None, "size_ci")).items()])
    long = CP.bands_long(wide, ["l_orderkey", "l_linenumber"], {"rate": "rate_ci", "size": "size_ci"})
    return long.select("l_orderkey", "l_linenumber", "feature", *[F.round(x, 6).alias(x) for x in ("value", "low", "high")])


def condition_self_join(spark, d):
    j = TB.paired_conditions(V.subject_values(spark, d), "subj", "stim", "routine", "cinderella")
    return j.select("subj", *[F.round(x, 6).alias(x) for x in j.columns if x != "subj"])


def subject_means(spark, d):
    v = V.subject_values(spark, d)
    scores = V.table(spark, d, "customer").select(c("c_custkey").alias("subj"), c("c_acctbal").alias("F1"))
    m = TB.with_scores(TB.subject_means(v, "subj", ["mean_value", "n_events"]), scores, "subj")
    return m.select("subj", F.round("mean_value", 6).alias("mean_value"), F.round("n_events", 6).alias("n_events"), "F1")


def text_merge(spark, d):
    docs = V.table(spark, d, "documents")
    syntax = docs.select("text", F.size(F.split("text", " ", -1)).alias("W"))
    return TB.merged_counts(docs.select("doc_id", "text"), syntax, "text", ["W"]).groupBy("doc_id", "W").agg(F.sum("n").alias("copies"))


def aligned_update(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", c("n_chars").cast("double").alias("x"))
    other = V.table(spark, d, "labels").select("doc_id", F.when(c("quality") == 1, c("toxic") * 100.0).alias("x"))
    return TB.aligned_update(docs, other, "doc_id", ["x"])


def resume_batches(spark, d):
    """Documents whose result is not stored yet."""
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    return TB.not_done(docs, V.table(spark, d, "labels"), "doc_id")


def ordered_batches(spark, d):
    """Documents enriched in batches, labelled ones by an earlier run; the number of each in the order they were taken."""
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/ordered-{uuid.uuid4()}"
    enrich = lambda rows: rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    size = docs.count() // 3 + 1
    RS.enrich_in_order(TB.keep_ids(docs, V.table(spark, d, "labels"), "doc_id"), enrich, path, "doc_id", ["doc_id"], size)
    RS.enrich_in_order(docs, enrich, path, "doc_id", ["doc_id"], size)
    return RS.committed_rows(spark, path).select("doc_id", "text_sha256", "order_number")


def kept_ids(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    return TB.keep_ids(docs, V.table(spark, d, "labels").where("quality = 1"), "doc_id")


def side_by_side(spark, d):
    docs = V.table(spark, d, "documents")
    return TB.side_by_side([docs.select("doc_id", "lang"), docs.select("doc_id", "n_chars"), V.table(spark, d, "labels")], "doc_id")


def value_counts(spark, d):
    return TB.value_counts(V.table(spark, d, "documents"), "source")


def summary_table(spark, d):
    s = TB.summary_table(V.spread_features(spark, d), V.FEATURES)
    return s.select("feature", "count", *[F.round(x, 4).alias(x) for x in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def top_documents(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", (c("n_chars") - 1000).alias("gap"))
    return TB.top_absolute(docs, "gap", 20, "doc_id")


def fixed_sample(spark, d):
    return TB.fixed_sample(V.table(spark, d, "events").select("event_id", "event_type"), 3000, "event_id")


def stacked_frames(spark, d):
    a = V.table(spark, d, "documents").select("doc_id", "lang")
    b = V.table(spark, d, "labels").select("doc_id", c("toxic").cast("int").alias("toxic"))
    return TB.stack([a, b])


def distinct_rows(spark, d):
    return V.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").dropDuplicates()


def long_form(spark, d):
    return melt(V.features(spark, d), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


def difference_report(spark, d):
    e = V.table(spark, d, "events").select("event_id", "user_id", "value")
    shifted = e.select("event_id", "user_id", F.when(c("value") > 10, c("value") + 0.5).otherwise(c("value")).alias("value"))
    r = TB.difference_report(e, shifted, "event_id")
    return r.select("event_id", "column", *[F.round(x, 6).alias(x) for x in ("left", "right", "gap")])


def review_queue(spark, d):
    q = R.review_queue(V.stories(spark, d).select("story_id", "altered_text"))
    verdicts = V.table(spark, d, "labels").select(c("doc_id").alias("story_id"), (c("quality") == 1).alias("good"))
    return R.review_queue(q, R.apply_verdicts(q, verdicts, "story_id")).select("story_id", "evaluation", "verified", "verified_text")


def _reviewed(spark, d):
    q = R.review_queue(V.stories(spark, d).select("story_id", "altered_text"))
    verdicts = V.table(spark, d, "labels").select(c("doc_id").alias("story_id"), (c("quality") == 1).alias("good"))
    return R.apply_verdicts(q, verdicts, "story_id")


def review_verdicts(spark, d):
    return _reviewed(spark, d).select("story_id", "evaluation", "verified")


def review_progress(spark, d):
    p = R.progress(_reviewed(spark, d))
    return p.select("reviewed", "total", F.round("percent", 6).alias("percent"))


def sentence_view(spark, d):
    idx = F.array((c("story_id") % 3).cast("int"), (c("story_id") % 5 + 3).cast("int"))
    return R.sentence_view(V.stories(spark, d).select("story_id", "altered_text", idx.alias("index_paraphrase")), "story_id")


def syntax_domains(spark, d):
    l = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        c("l_quantity").alias("W"), (c("l_linenumber") - 1).alias("S"), (c("l_discount") * 100).alias("T"), (c("l_tax") * 100).alias("C"),
        c("l_discount").alias("T/S"), c("l_tax").alias("C/T"), c("l_quantity").alias("DC/C"), c("l_extendedprice").alias("VP/T"), c("l_discount").alias("CN/C"),
    )
    s = X.domain_scores(l)
    return s.select("l_orderkey", "l_linenumber", *[F.round(x, 5).alias(x) for x in ("MLS", "MLT", "MLC", "Length", "Global", "Clausal", "Phrasal")])


QUERIES = {
    f.__name__: f
    for f in (
        simulation_grid, drawn_temperatures, sweep_grid, heavy_tail_weights, heavy_tail_pick, paraphrase_inserted_online,
        paraphrase_inserted_offline, paraphrase_flags, control_corpus, aggregated_corpus, enriched_corpus, labelled_corpus,
        five_part_story, effective_text, marked_text, repaired_rows, row_composites, density_composites, composites_long,
        condition_self_join, subject_means, text_merge, aligned_update, resume_batches, ordered_batches, kept_ids, side_by_side, value_counts,
        summary_table, top_documents, fixed_sample, stacked_frames, distinct_rows, long_form, difference_report, review_queue,
        review_verdicts, review_progress, sentence_view, syntax_domains,
    )
}

U = S.uniform
_GRID = f"""g AS (SELECT prompt, CAST(sim AS INTEGER) AS sim, 1.0 + {U("'sim'", 'prompt', 'sim', "'t'")} * 4.0 AS t,
  CAST(floor({U("'sim'", 'prompt', 'sim', "'b'")} * 3) + 3 AS INTEGER) AS num_beams
  FROM (SELECT DISTINCT lang || '/' || source AS prompt FROM documents), range(0, 200) r(sim))"""
_PAIRED = f"""{S.sentences_cte()},
pd AS (SELECT doc_id AS story_id, s, len(s) AS n, CASE WHEN len(s) >= 3 THEN doc_id % (len(s) - 1) END AS src,
       CASE WHEN len(s) >= 3 THEN len(s) - 1 END AS dst FROM sent)"""
_PLAN = f"""{S.sentences_cte()},
base AS (SELECT doc_id AS story_id, s, len(s) AS n, {U("'ins'", 'doc_id', "'p'")} < {P} AND len(s) > 2 AS go,
         {U("'ins'", 'doc_id', "'q'")} < {Q} AS cl, {U("'ins'", 'doc_id', "'i'")} AS u FROM sent),
wt AS (SELECT story_id, i, u, n, pow(CASE WHEN cl THEN n - 1 - i ELSE i + 1 END, -{ALPHA}) AS w
       FROM (SELECT *, unnest(range(0, n - 1)) AS i FROM base WHERE go)),
cw AS (SELECT story_id, n, u, sum(w) OVER (PARTITION BY story_id ORDER BY i) / sum(w) OVER (PARTITION BY story_id) AS cum FROM wt),
pick AS (SELECT story_id, least(count(*) FILTER (cum <= u), n - 2) AS src FROM cw GROUP BY story_id, n),
plan AS (SELECT b.*, CASE WHEN go THEN CASE WHEN cl THEN 'close' ELSE 'distant' END END AS kind, p.src,
         CASE WHEN go THEN n - 1 END AS dst FROM base b LEFT JOIN pick p USING (story_id))"""


def _composite_sql() -> str:
    def stats(exprs, z=1.96):
        k = len(exprs)
        mean = "(" + " + ".join(f"({e})" for e in exprs) + f") / {k}.0"
        std = "sqrt((" + " + ".join(f"pow(({e}) - {mean}, 2)" for e in exprs) + f") / {k - 1}.0)"
        return mean, std, f"({z} * {std} / sqrt({k}.0))"

    cols: dict[str, str] = {"narrative_speed_ci": "CAST(0.0 AS DOUBLE)"}
    models = ["w2v", "glove", "fast_text", "sentence_sim"]
    source = {
        "all_cosine_sentences_similarity_mean": [f"l_discount * {k + 1} + 0.1" for k in range(4)],
        "all_cosine_sentences_similarity_std": [f"l_tax * {k + 2}" for k in range(4)],
        "consecutive_cosine_sentences_similarity_mean": [f"l_discount * {k + 1} + 0.2" for k in range(4)],
        "consecutive_cosine_sentences_similarity_std": [f"l_tax * {k + 2}" for k in range(4)],
        "consecutive_wmd_sentences_similarity_mean": [f"l_quantity / {k + 10}.0" for k in range(3)],
        "all_wmd_sentences_similarity_mean": [f"l_quantity / {k + 10}.0" for k in range(3)],
        "all_wmd_sentences_similarity_std": [f"l_tax / {k + 1}.0" for k in range(3)],
    }
    for suffix, names in CP.ACROSS_MODELS.items():
        cols |= dict(zip(names, stats(source[suffix])))
    order = list(dict.fromkeys(x for g in CP.GROUPS.values() for x in g))
    value = {name: f"l_discount * {k + 1} / 10.0 + l_tax * {k % 3}" for k, name in enumerate(order)}
    for g, members in CP.GROUPS.items():
        cols |= dict(zip((g, f"{g}_std", f"{g}_ci"), stats([value[m] for m in members])))
    for g, members in CP.TOPIC_GROUPS.items():
        m, _, ci = stats([value[x] for x in members])
        cols |= {g: m, f"{g}_ci": ci}
    body = ", ".join(f'round(sum({e}), 6) AS "{n}"' for n, e in cols.items())
    return f"SELECT l_orderkey % 50 AS bucket, {body} FROM lineitem GROUP BY 1"


_FOUR = [f"CAST({x} AS DOUBLE)" for x in V.FEATURES]
_MEAN4 = "(" + " + ".join(_FOUR) + ") / 4.0"
_STD4 = "sqrt((" + " + ".join(f"pow({x} - {_MEAN4}, 2)" for x in _FOUR) + ") / 3.0)"
_Z = lambda e: f"(({e}) - avg({e}) OVER ()) / stddev_samp({e}) OVER ()"

ORACLES = {
    "simulation_grid": f"WITH {_GRID} SELECT prompt, sim, round(t, 6) AS temperature, num_beams FROM g",
    "drawn_temperatures": f"WITH {_GRID} SELECT num_beams, count(*) AS n, round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS std FROM g GROUP BY num_beams",
    "sweep_grid": """
SELECT llm_model, CAST(1 AS INTEGER) AS n, CAST(0.1 AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q, CAST(alpha AS DOUBLE) AS alpha, band
FROM (SELECT DISTINCT source AS llm_model FROM documents), (VALUES (0.9), (0.5), (0.1)) a(q), (VALUES (0.5), (0.7)) b(alpha),
(VALUES (''), ('_temperature_2-3'), ('_temperature_4-5')) t(band)""",
    "heavy_tail_weights": f"""
WITH {S.sentences_cte()},
w AS (SELECT doc_id AS story_id, len(s) AS n, unnest(range(0, len(s))) AS i FROM sent),
x AS (SELECT story_id, i, pow(i + 1, -{ALPHA}) AS a, pow(n - i, -{ALPHA}) AS b FROM w)
SELECT story_id, CAST(i AS INTEGER) AS i, round(a / sum(a) OVER (PARTITION BY story_id), 6) AS p_distant,
  round(b / sum(b) OVER (PARTITION BY story_id), 6) AS p_close FROM x""",
    "heavy_tail_pick": f"WITH {_PLAN} SELECT story_id, kind, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM plan",
    "paraphrase_inserted_online": f"""
WITH {_PLAN}
SELECT story_id, kind, CASE WHEN go THEN regexp_replace(array_to_string(list_concat(list_concat(s[:-2], ['Again: ' || lower(s[src + 1])]), [s[-1]]), ' '), '\\.+', '.', 'g')
  ELSE coalesce(array_to_string(s, ' '), '') END AS altered_text FROM plan""",
    "paraphrase_inserted_offline": f"""
WITH a AS (SELECT doc_id, text, string_split(text, '.') AS p, {U("'off'", 'doc_id')} AS u FROM documents),
b AS (SELECT *, CASE WHEN doc_id % 50 = 0 THEN len(p) ELSE floor(u * (len(p) - 1)) + 1 END AS i FROM a),
k AS (SELECT *, i >= len(p) AS bad, CAST(i AS BIGINT) AS j FROM b)
SELECT doc_id, CASE WHEN bad THEN text ELSE array_to_string(list_concat(list_concat(p[:j], [p[j + 1] || '. ' || 'Again: ' || lower(p[j + 1])]), p[j + 2:]), '.') END AS altered_text,
  bad AS rejected FROM k""",
    "paraphrase_flags": f"""
WITH {_PAIRED}
SELECT story_id, src IS NOT NULL AS one, CAST(src = 1 AS INTEGER) AS first, CAST(dst - src = 1 AS INTEGER) AS consecutive,
  CAST(coalesce(len(string_split(CASE WHEN src = 0 THEN s[-1] ELSE s[src] END, ' ')) < 5, FALSE) AS INTEGER) AS short,
  CAST(coalesce(src >= n - 2, FALSE) AS INTEGER) AS at_end FROM pd""",
    "control_corpus": f"""
WITH {_PAIRED} SELECT story_id, d.lang AS prompt, array_to_string(s[:-2], ' ') AS altered_text
FROM pd JOIN documents d ON d.doc_id = story_id WHERE src IS NOT NULL""",
    "aggregated_corpus": """
WITH a AS (SELECT doc_id AS story_id, doc_id % 4 AS k, doc_id % 5 AS i, doc_id % 3 AS g FROM documents WHERE NOT regexp_matches(text, 'www|http'))
SELECT story_id, CAST(CASE WHEN k < 2 THEN 0 ELSE k - 1 END AS INTEGER) AS clean_paraphase_type, CAST(CASE WHEN k < 2 THEN 0 ELSE 2 END AS INTEGER) AS n_idx,
  k >= 2 AS one_paraphrase, CAST(CASE WHEN k >= 2 THEN i = 1 END AS INTEGER) AS first_paraphrase, CAST(CASE WHEN k >= 2 THEN g = 1 END AS INTEGER) AS consecutive_paraphrase FROM a""",
    "enriched_corpus": f"""
WITH {_PAIRED},
ctl AS (SELECT story_id AS doc_id, array_to_string(s[:-2], ' ') AS text FROM pd WHERE src IS NOT NULL),
{S.sentences_cte('csent', 'ctl')},
{S.sentences_cte('bsent', 'benchmark', 'item_id')},
allrows AS (
  SELECT 'altered' AS source, src IS NOT NULL AS had_paraphrase, 1 AS t, n, 1 AS pr FROM pd
  UNION ALL SELECT 'control', TRUE, 0, len(s), 1 FROM csent
  UNION ALL SELECT 'story', FALSE, 0, len(s), NULL FROM bsent)
SELECT source, had_paraphrase, CAST(t AS INTEGER) AS clean_paraphase_type, count(*) AS n, CAST(sum(n) AS BIGINT) AS sentences, count(pr) AS with_prompt
FROM allrows WHERE n > 2 AND n < 20 GROUP BY ALL""",
    "labelled_corpus": """
WITH a AS (SELECT doc_id, n_chars / 1000.0 AS t, doc_id % 3 AS k FROM documents),
b AS (SELECT doc_id, CASE WHEN t < 2 THEN 'low_temperature' WHEN t < 4 THEN 'medium_temperature' ELSE 'high_temperature' END AS temperature_enc,
  CASE WHEN k = 0 THEN 'no_paraphrase' ELSE 'paraphrase' END AS paraphrase_enc FROM a),
l AS (SELECT *, temperature_enc || '_with_' || paraphrase_enc AS combined_label FROM b)
SELECT *, CAST(dense_rank() OVER (ORDER BY combined_label) - 1 AS INTEGER) AS cat_label, round(('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0, 9) AS random FROM l""",
    "five_part_story": f"WITH {S.sentences_cte()} SELECT doc_id AS story_id, CASE WHEN len(s) >= 5 THEN array_to_string(s[1:5], ' ') END AS text FROM sent",
    "effective_text": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE upper(lang) END AS effective FROM documents",
    "marked_text": f"""
WITH {S.sentences_cte()}
SELECT doc_id, CASE WHEN len(s) > 0 THEN replace(text, s[1], '<mark>' || s[1] || '</mark>') END AS marked FROM sent JOIN documents USING (doc_id)""",
    "repaired_rows": """
SELECT lang AS prompt, source AS generated_text, CAST(doc_id AS VARCHAR) AS model_name, CAST(n_chars AS VARCHAR) AS temperature, '4' AS num_beams,
  '(1, 2)' AS index_paraphrase, '[''close'']' AS paraphrase_type, translate(text, chr(9) || chr(10) || chr(13), '   ') AS altered_text
FROM documents WHERE doc_id % 10 <> 3""",
    "row_composites": f"SELECT l_orderkey, l_linenumber, round({_MEAN4}, 4) AS mean, round({_STD4}, 4) AS std, round(1.96 * {_STD4} / 2, 4) AS ci FROM lineitem",
    "density_composites": _composite_sql(),
    "composites_long": """
WITH w AS (SELECT l_orderkey, l_linenumber, (l_discount + l_tax) / 2 AS rate, 1.96 * abs(l_discount - l_tax) / 2 AS rate_ci,
  (l_quantity + l_discount) / 2 AS size, 1.96 * abs(l_quantity - l_discount) / 2 AS size_ci FROM lineitem)
SELECT l_orderkey, l_linenumber, 'rate' AS feature, round(rate, 6) AS value, round(rate - rate_ci, 6) AS low, round(rate + rate_ci, 6) AS high FROM w
UNION ALL SELECT l_orderkey, l_linenumber, 'size', round(size, 6), round(size - size_ci, 6), round(size + size_ci, 6) FROM w""",
    "condition_self_join": """
WITH v AS (SELECT user_id AS subj, event_type, avg(value) AS m, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL)
SELECT r.subj, round(r.m, 6) AS mean_value_routine, r.n AS n_events_routine, round(p.m, 6) AS mean_value_cinderella, p.n AS n_events_cinderella
FROM v r JOIN v p USING (subj) WHERE r.event_type = 'click' AND p.event_type = 'purchase'""",
    "subject_means": """
WITH v AS (SELECT user_id AS subj, event_type, avg(value) AS m, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
a AS (SELECT subj, round(avg(m), 6) AS mean_value, round(avg(n), 6) AS n_events FROM v GROUP BY subj)
SELECT subj, mean_value, n_events, c_acctbal AS F1 FROM a LEFT JOIN customer ON c_custkey = subj""",
    "text_merge": """
SELECT a.doc_id, CAST(len(string_split(a.text, ' ')) AS INTEGER) AS W, count(*) AS copies FROM documents a JOIN documents b ON a.text = b.text GROUP BY ALL""",
    "aligned_update": """
SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN toxic * 100.0 END, CAST(n_chars AS DOUBLE)) AS x FROM documents LEFT JOIN labels USING (doc_id)""",
    "resume_batches": "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "ordered_batches": """
SELECT doc_id, sha256(text) AS text_sha256, row_number() OVER (ORDER BY doc_id NOT IN (SELECT doc_id FROM labels), doc_id) - 1 AS order_number FROM documents""",
    "kept_ids": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "side_by_side": "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "value_counts": "SELECT source, count(*) AS count FROM documents GROUP BY source",
    "summary_table": " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count({f}) AS count, round(avg({f}), 4) AS mean, round(stddev_samp({f}), 4) AS std, round(CAST(min({f}) AS DOUBLE), 4) AS min, "
        f"round(quantile_cont({f}, 0.25), 4) AS q25, round(quantile_cont({f}, 0.5), 4) AS q50, round(quantile_cont({f}, 0.75), 4) AS q75, round(CAST(max({f}) AS DOUBLE), 4) AS max FROM lineitem"
        for f in V.FEATURES
    ),
    "top_documents": "SELECT doc_id, n_chars - 1000 AS gap FROM documents ORDER BY abs(n_chars - 1000) DESC, doc_id LIMIT 20",
    "fixed_sample": "SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|42') LIMIT 3000",
    "stacked_frames": "SELECT doc_id, lang, CAST(NULL AS INTEGER) AS toxic FROM documents UNION ALL SELECT doc_id, NULL, CAST(toxic AS INTEGER) FROM labels",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem",
    "long_form": "SELECT l_orderkey, l_linenumber, 'l_discount' AS feature, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem",
    "difference_report": """
SELECT event_id, 'value' AS "column", round(value, 6) AS "left", round(value + 0.5, 6) AS "right", CAST(0.5 AS DOUBLE) AS gap FROM events WHERE value > 10""",
    "review_queue": """
SELECT doc_id AS story_id, CAST(0 AS INTEGER) AS evaluation, CAST(0 AS INTEGER) AS verified, text AS verified_text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "review_verdicts": """
SELECT doc_id AS story_id, CAST(coalesce(quality, 0) AS INTEGER) AS evaluation, CAST(quality IS NOT NULL AS INTEGER) AS verified FROM documents LEFT JOIN labels USING (doc_id)""",
    "review_progress": """
SELECT count(quality) AS reviewed, count(*) AS total, round(100.0 * count(quality) / count(*), 6) AS percent FROM documents LEFT JOIN labels USING (doc_id)""",
    "sentence_view": """
SELECT story_id, CAST(i - 1 AS INTEGER) AS i, p[i] AS sentence, i - 1 IN (story_id % 3, story_id % 5 + 3) AS in_pair
FROM (SELECT doc_id AS story_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents)) WHERE length(p[i]) > 2""",
    "syntax_domains": f"""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_linenumber - 1, 0) AS mls, l_quantity / nullif(l_discount * 100, 0) AS mlt, l_quantity / nullif(l_tax * 100, 0) AS mlc,
  l_discount, l_tax, l_quantity, l_extendedprice FROM lineitem),
z AS (SELECT *, {_Z('mls')} AS z1, {_Z('mlt')} AS z2, {_Z('mlc')} AS z3, {_Z('l_discount')} AS zd, {_Z('l_tax')} AS zt, {_Z('l_quantity')} AS zq, {_Z('l_extendedprice')} AS zp FROM a)
SELECT l_orderkey, l_linenumber, round(mls, 5) AS MLS, round(mlt, 5) AS MLT, round(mlc, 5) AS MLC,
  round((coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0)) / nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT, 0), 5) AS Length,
  round(zd, 5) AS "Global", round((zt + zq) / 2, 5) AS Clausal, round((zp + zd) / 2, 5) AS Phrasal FROM z""",
}

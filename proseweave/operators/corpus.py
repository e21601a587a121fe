"""Building controlled corpora: simulation grids, paraphrase positions, insertion and removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..session import cut_lineage
from .cleaning import drop_linked

Paraphraser = Callable[[DataFrame], DataFrame]


# --- grids ---------------------------------------------------------------------------------


def simulation_grid(prompts: DataFrame, n: int, low: float, high: float, beams: tuple[int, int] = (3, 5), seed: str = "sim") -> DataFrame:
    """``n`` simulations per prompt with a uniform temperature and a whole number of beams. Rows are
    multiplied in place (no join), draws depend only on (seed, prompt, sim)."""
    rows = prompts.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sim"))
    u = T.uniform_of(F.lit(seed), F.col("prompt"), F.col("sim"), F.lit("t"))
    b = T.uniform_of(F.lit(seed), F.col("prompt"), F.col("sim"), F.lit("b"))
    span = beams[1] - beams[0] + 1
    return rows.withColumns(
        {"temperature": F.lit(low) + u * (high - low), "num_beams": (F.floor(b * span) + beams[0]).cast("int")}
    )


def sweep_grid(models: DataFrame, **choices: list) -> DataFrame:
    """Every combination of the given settings for each row of ``models``."""
    out = models
    for name, values in choices.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


# --- positions -----------------------------------------------------------------------------


def position_weights(n: Column, alpha: float | Column, close: bool = False) -> Column:
    """Heavy-tailed weights over positions 0..n-1, P(i) ~ 1/(i+1)^alpha, mirrored for close ones."""
    a = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    raw = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.pow(i.cast("double"), -a))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x)
    p = T.let(raw, lambda r: T.let(total(r), lambda t: F.transform(r, lambda x: x / t)))
    return F.when(n > 0, F.reverse(p) if close else p)


def pick_position(weights: Column, u: Column) -> Column:
    """Inverse-CDF draw: number of cumulative weights not above ``u``."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k"))
    step = lambda v: lambda s, w: F.struct((s["c"] + w).alias("c"), (s["k"] + (s["c"] + w <= v).cast("int")).alias("k"))
    count = lambda w: T.let(u, lambda v: F.aggregate(w, start, step(v))["k"])
    return T.let(weights, lambda w: F.least(count(w), F.size(w) - 1))


def plan_insertions(df: DataFrame, p: float, q: float, alpha: float, seed: str = "ins", limit: int = 1, sentences: str = "sentences",
                    row_id: str = "story_id") -> DataFrame:
    """Decide per text: insert with probability p when it has more than two sentences and ``limit``
    allows one; close with probability q, else distant. Adds ``kind`` (null = none), ``src``, ``dst``."""
    draw = lambda tag: T.uniform_of(F.lit(seed), F.col(row_id), F.lit(tag))
    n = F.size(sentences)
    go = (draw("p") < p) & (n > 2) & F.lit(limit > 0)
    close = draw("q") < q
    u = draw("i")
    weights = F.when(close, position_weights(n - 1, alpha, True)).otherwise(position_weights(n - 1, alpha, False))
    plan = F.struct(
        F.when(go, F.when(close, "close").otherwise("distant")).alias("kind"),
        F.when(go, pick_position(weights, u)).alias("src"),
        F.when(go, n - 1).alias("dst"),
    )
    return T.once(df, "_plan", plan).select(*df.columns, "_plan.*")


def offline_position(pieces: Column, u: Column) -> tuple[Column, Column]:
    """Uniform piece in 1..len-1, paired with the last piece."""
    last = F.size(pieces) - 1
    return (F.floor(u * last) + 1).cast("int"), last


# --- insertion and removal -----------------------------------------------------------------


def paraphrase_distinct(df: DataFrame, sentence: str, paraphraser: Paraphraser) -> DataFrame:
    """Add ``paraphrase``; each distinct sentence is paraphrased once (lookup table or
    ``mapInPandas`` around a model). Rows without a sentence keep a null. The rows are stored first, as they are read
    three times: what led to them, such as the sentence splitter, runs once."""
    df = cut_lineage(df)
    todo = df.where(F.col(sentence).isNotNull()).select(F.col(sentence).alias("sentence")).distinct()
    done = paraphraser(todo).select(F.col("sentence").alias(sentence), "paraphrase")
    # rows without a sentence (most rows of an online run) never meet the join, where they would share one key
    known = df.where(F.col(sentence).isNotNull()).join(done, sentence, "left").select(*df.columns, "paraphrase")
    missing = df.where(F.col(sentence).isNull()).withColumn("paraphrase", F.lit(None).cast(done.schema["paraphrase"].dataType))
    return known.unionByName(missing)


def insert_online(sentences: Column, paraphrase: Column) -> Column:
    """Text with the paraphrase placed before the last, still open sentence."""
    n = F.size(sentences)
    parts = F.concat(F.slice(sentences, F.lit(1), n - 1), F.array(paraphrase), F.slice(sentences, n, F.lit(1)))
    return T.squeeze_periods(F.array_join(parts, " "))


def insert_offline(pieces: Column, index: Column, paraphrase: Column) -> Column:
    """Pieces joined by periods again, with the paraphrase after piece ``index``."""
    changed = F.transform(pieces, lambda x, i: F.when(i == index, F.concat(x, F.lit(". "), paraphrase)).otherwise(x))
    return F.array_join(changed, ".")


def alter_offline(df: DataFrame, paraphraser: Paraphraser, text: str = "text", index: str = "index_paraphrase") -> DataFrame:
    """Insert a paraphrase into every text at its index. An index outside the text leaves it as it is
    and is reported in ``error``."""
    src = F.try_element_at(F.col(index), F.lit(1))
    base = T.once(df, "_pieces", T.period_pieces(F.col(text)))
    valid = (src >= 0) & (src < F.size("_pieces"))
    base = base.withColumns(
        {
            "error": F.when(F.coalesce(valid, F.lit(False)), F.lit(None).cast("string")).otherwise(
                F.concat(F.lit("index outside 0.."), (F.size("_pieces") - 1).cast("string"))
            ),
            "_s": F.when(valid, F.get(F.col("_pieces"), src)),
        }
    )
    done = paraphrase_distinct(base, "_s", paraphraser)
    return done.withColumn(
        "altered_text", F.when(F.col("error").isNull(), insert_offline(F.col("_pieces"), src, F.col("paraphrase"))).otherwise(F.col(text))
    ).drop("_pieces", "_s", "paraphrase")


def alter_online(df: DataFrame, paraphraser: Paraphraser, sentences: str = "sentences") -> DataFrame:
    """Apply planned insertions (``src``/``dst``/``kind``): adds ``altered_text``."""
    picked = df.withColumn("_s", F.get(F.col(sentences), F.col("src")))
    done = paraphrase_distinct(picked, "_s", paraphraser)
    return done.withColumn(
        "altered_text",
        F.when(F.col("kind").isNotNull(), insert_online(F.col(sentences), F.col("paraphrase"))).otherwise(F.array_join(sentences, " ")),
    ).drop("_s", "paraphrase")


def remove_paraphrase(sentences: Column, index: Column) -> Column:
    """Text without the paraphrase; null when there is no pair."""
    dst = F.try_element_at(index, F.lit(2))
    kept = T.let(dst, lambda k: F.filter(sentences, lambda s, i: i != k))
    return F.when(L.is_pair(index), F.array_join(kept, " "))


# Columns of the control corpus.
CONTROL_COLUMNS = [
    "prompt", "generated_text", "model_name", "temperature", "num_beams", "text", "llm_model", "paraphrase_model",
    "sentences", "consecutive_paraphrase", "first_paraphrase", "one_paraphrase", "nb_paraphrase_max",
    "paraphase_type", "p_paraphrase", "q_paraphrase", "alpha_paraphrase", "clean_paraphrase_index",
]


def control_corpus(df: DataFrame, keep: list[str] | None = None, sentences: str | None = None) -> DataFrame:
    """The same texts with their paraphrase taken out; texts without one are dropped. ``sentences`` names a column that
    holds the sentences of ``altered_text`` already, so that the splitter need not run again."""
    split = df.withColumn("sentences", F.col(sentences)) if sentences else T.with_sentences(df, "altered_text")
    names = [c for c in (keep or CONTROL_COLUMNS) if c in split.columns]
    out = split.select(*names, remove_paraphrase(F.col("sentences"), F.col("clean_paraphrase_index")).alias("altered_text"))
    return out.where(F.col("altered_text").isNotNull())


def aggregate_corpora(runs: DataFrame) -> DataFrame:
    """Codes, parsed index and shape flags over the union of all runs; linked texts are dropped."""
    idx = F.col("clean_paraphrase_index")
    return (
        drop_linked(runs)
        .withColumns(
            {
                "clean_paraphase_type": L.kind_code(F.col("paraphase_type")),
                "clean_paraphrase_index": T.index_list(F.col("index_paraphrase")),
            }
        )
        .withColumns(
            {
                "one_paraphrase": L.is_pair(idx),
                "first_paraphrase": L.first_flag(idx),
                "consecutive_paraphrase": L.consecutive_flag(idx),
            }
        )
    )


def enrich(aggregated: DataFrame, control: DataFrame, stories: DataFrame | None = None, low: int | None = None, high: int | None = None,
           sentences: str | None = None) -> DataFrame:
    """Stack altered texts, their controls and optional outside stories with provenance columns.
    ``low``/``high`` bound the sentence count (strict). ``sentences`` names a column of ``aggregated`` that holds the
    sentences of its ``altered_text`` already; the other texts are new and are split here."""
    from ..functions.predicates import in_window

    parts = [
        aggregated.withColumns({"source": F.lit("altered"), "had_paraphrase": L.is_pair(F.col("clean_paraphrase_index"))}),
        control.withColumns({"source": F.lit("control"), "had_paraphrase": F.lit(True), "clean_paraphase_type": F.lit(0)}),
    ]
    if stories is not None:
        parts.append(stories.withColumns({"source": F.lit("story"), "had_paraphrase": F.lit(False), "clean_paraphase_type": F.lit(0)}))
    held = []
    if sentences:
        held.append(parts.pop(0).withColumn("sentences", F.col(sentences)))
    out = parts[0].drop("sentences")
    for p in parts[1:]:
        out = out.unionByName(p.drop("sentences"), allowMissingColumns=True)
    out = T.with_sentences(out, "altered_text")
    for p in held:
        out = p.unionByName(out, allowMissingColumns=True)
    out = out.withColumn("num_sentences", F.size("sentences"))
    return out.where(in_window(F.col("num_sentences"), low, high))


def add_labels(cleaned: DataFrame, temperature: str = "temperature", row_id: str = "index") -> DataFrame:
    """Band, paraphrase name and combined label, plus a random control column drawn from the row id."""
    return cleaned.withColumns(
        {
            "has_paraphrase": (F.col("clean_paraphase_type") != 0).cast("int"),
            "temperature_enc": L.band_name(F.col(temperature)),
            "random": T.uniform_of(F.lit(42), F.col(row_id)),
        }
    ).withColumn("paraphrase_enc", L.paraphrase_name(F.col("has_paraphrase"))).withColumn(
        "combined_label", L.combined_label(F.col("temperature_enc"), F.col("paraphrase_enc"))
    )

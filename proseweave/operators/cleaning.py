"""Corpus cleaning: all flags in one projection, the funnel in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import predicates as P
from .ordered import exact_quantiles, text_ranks


def with_flags(df: DataFrame, text: str = "altered_text", sentences: str = "sentences", index: str | None = None,
               low: int | None = 5, high: int | None = 20) -> DataFrame:
    """Add every cleaning flag. ``index`` names the paraphrase index array, if there is one."""
    t, n = F.col(text), F.size(sentences)
    flags = {
        "num_sentences": n,
        "in_window": P.in_window(n, low, high),
        "has_phone": P.has_phone(t),
        "has_address": P.has_address(t),
        "has_mail": P.has_mail(t),
        "has_list": P.looks_like_list(t),
    }
    if index:
        flags["paraphrase_is_short"] = L.short_flag(F.col(index), F.col(sentences)) == 1
        flags["paraphrase_at_end"] = L.end_flag(F.col(index), n) == 1
    return df.withColumns(flags)


def steps_of(df: DataFrame, prompts: list[str] | None = None) -> list[tuple[str, Column]]:
    """The funnel in order: (step name, keep condition)."""
    out = [("sentence_window", F.col("in_window"))]
    for step, flag in (
        ("phone", "has_phone"),
        ("address", "has_address"),
        ("mail", "has_mail"),
        ("list", "has_list"),
        ("short_paraphrase", "paraphrase_is_short"),
        ("paraphrase_at_end", "paraphrase_at_end"),
    ):
        if flag in df.columns:
            out.append((step, ~F.col(flag)))
    if prompts is not None:
        out.append(("prompt", F.col("prompt").isin(prompts)))
    return out


def funnel(flagged: DataFrame, prompts: list[str] | None = None) -> DataFrame:
    """(step_no, step, n_left): rows left after each filter, from a single pass."""
    keep = F.lit(True)
    aggs, names = [F.count(F.lit(1)).alias("s0")], ["start"]
    for i, (name, cond) in enumerate(steps_of(flagged, prompts), start=1):
        keep = keep & F.coalesce(cond, F.lit(False))
        aggs.append(F.count(F.when(keep, 1)).alias(f"s{i}"))
        names.append(name)
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"s{i}").alias("n_left")) for i, n in enumerate(names)])
    return flagged.agg(*aggs).select(F.inline(rows))


def keep_clean(flagged: DataFrame, prompts: list[str] | None = None) -> DataFrame:
    keep = F.lit(True)
    for _, cond in steps_of(flagged, prompts):
        keep = keep & F.coalesce(cond, F.lit(False))
    return flagged.where(keep)


def drop_linked(df: DataFrame, text: str = "altered_text") -> DataFrame:
    """Drop texts with a link; a missing text is dropped too."""
    return df.where(~P.has_link(F.col(text)))


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Integer code of a category = its position among the sorted distinct values (missing: -1)."""
    codes = text_ranks(df, column, out)
    return df.join(codes, column, "left").withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(-1)))


def lexical_repetition(df: DataFrame, score: str, out: str = "has_lexical_repetition") -> DataFrame:
    """1 when the score is above the median of the positive scores."""
    positive = df.where(F.col(score) > 0).select(F.lit(score).alias("feature"), F.col(score).alias("value"))
    median = exact_quantiles(positive, {"median": 0.5}).select("median").scalar()
    return df.withColumn(out, F.coalesce((F.col(score) > median).cast("int"), F.lit(0)))


def without_infinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(~P.any_infinite(*[F.col(f"`{c}`").cast("double") for c in columns]))

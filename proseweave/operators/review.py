"""Review of inserted paraphrases as table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def review_queue(corpus: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """A fresh queue, or the rows of a saved review that are still open."""
    if saved is not None:
        return saved.where(F.col("verified") == 0)
    return corpus.withColumns({"evaluation": F.lit(0), "verified": F.lit(0), "verified_text": F.col("altered_text")})


def apply_verdicts(queue: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """``verdicts`` holds (key, good boolean[, verified_text]): good gives 1/1, not good 0/1."""
    cols = [key, "good"] + (["verified_text"] if "verified_text" in verdicts.columns else [])
    v = verdicts.select(*[F.col(c).alias(c if c == key else f"_{c}") for c in cols])
    joined = queue.join(v, key, "left")
    new = {
        "evaluation": F.coalesce(F.col("_good").cast("int"), "evaluation"),
        "verified": F.when(F.col("_good").isNotNull(), 1).otherwise(F.col("verified")),
    }
    if "verified_text" in verdicts.columns:
        new["verified_text"] = F.coalesce("_verified_text", "verified_text")
    return joined.withColumns(new).select(queue.columns)


def progress(queue: DataFrame) -> DataFrame:
    done = F.sum("verified")
    total = F.count(F.lit(1))
    return queue.agg(done.alias("reviewed"), total.alias("total"), (F.lit(100.0) * done / F.nullif(total, F.lit(0))).alias("percent"))


def sentence_view(df: DataFrame, key: str, text: str = "altered_text", index: str = "index_paraphrase") -> DataFrame:
    """(key, i, sentence, in_pair): numbered pieces longer than two characters."""
    pieces = df.select(key, index, F.posexplode(T.period_pieces(F.col(text))).alias("i", "sentence"))
    return pieces.where(F.length("sentence") > 2).select(
        key, "i", "sentence", F.array_contains(index, F.col("i")).alias("in_pair")
    )

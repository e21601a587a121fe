"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

The tokens of each (source, language, topic) cell are raked under the bound that no document can be taken more than once:
the expected tokens of a cell are its tokens times min(1, factor), and each step of a sweep scales the factors of a
category so that just this bounded sum meets its target. The bounded factor is the probability of the cell's documents,
so the sample itself, not an unbounded weight, has the target marginals. A document is kept if the uniform that md5 gives
its id is below its probability, so a repeated run keeps the same ones.

Targets default to tempered marginals: a category's share to the power ``temper``, normalised; a table (category, share)
may be given for each dimension instead, with categories it does not list at share 0. The sample is to hold ``budget`` of
all tokens. Where a category has fewer tokens than its share of that, all of them are its target and the rest of the
budget goes to the other categories by their shares; ``target_report`` lists the share asked for, the share within
reach and the share expected. The targets of three dimensions can still exclude each other; then the last dimension is met and
the report shows the gap of the others. The cell table is as small as the categories allow; it is never collected.

Defined cases: null source or language is the category ``(none)``; null and empty texts have no tokens, and documents in
a cell without tokens get probability 0; a null id has the uniform of the empty
string; repeated rows share their id's fate; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
#: First topic with a cue in the text; ``prose`` if none has.
TOPICS = (("credential", ("token = ", "TOKEN = ")), ("license", ("icensed under", "ICENSED", "MIT License")), ("contact", ("@",)), ("table", (" | ",)), ("shout", ("!!",)))
SWEEPS = 12
TEMPER = 0.5
BUDGET = 0.5
#: Cells up to this number are raked in one partition and broadcast to the documents, more are shuffled.
BROADCAST_CELLS = 20_000


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, cues in reversed(TOPICS):
        hit = F.lit(False)
        for cue in cues:
            hit = hit | F.contains(text, F.lit(cue))
        out = F.when(hit, name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Runs of signs other than blanks, tabs and line ends: a run begins where a blank is followed by another sign."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def uniform(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def described(documents: DataFrame, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """The documents with ``_source``, ``_lang``, ``_topic`` and ``_tokens``."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return documents.withColumns({"_source": named(source), "_lang": named(lang), "_topic": topic_of(F.coalesce(F.col(text), F.lit(""))), "_tokens": token_count(F.col(text))})


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").cast("double").alias("t"))


def with_targets(cells: DataFrame, targets: dict[str, DataFrame] | None, temper: float) -> DataFrame:
    """Columns ``to_<dimension>``: the share each cell's category should have."""
    for d in DIMENSIONS:
        if targets and d in targets:
            given = targets[d]
            share = given.select(F.col(given.columns[0]).alias(d), (F.col(given.columns[1]) / F.sum(given.columns[1]).over(W.partitionBy(F.lit(0)))).alias(f"to_{d}"))
        else:
            powered = cells.groupBy(d).agg(F.sum("t").alias("t")).select(d, F.when(F.col("t") > 0, F.pow("t", F.lit(temper))).otherwise(0.0).alias("p"))
            total = powered.agg(F.sum("p")).first()[0] or 1.0
            share = powered.select(d, (F.col("p") / F.lit(total)).alias(f"to_{d}"))
        cells = cells.join(share, d, "left").fillna(0.0, [f"to_{d}"])
    return cells


def water_level(rows: DataFrame, by: list[str], avail: Column, weight: Column, total: Column) -> DataFrame:
    """Column ``_level``: the x of each group at which the sum of min(avail, weight * x) is ``total``.

    In order of falling weight / avail a full prefix is followed by open rows. The x that each prefix implies rises while
    its rows are full and falls after them, so the greatest one is the solution; two running sums give all."""
    ratio, ties = F.when(avail > 0, weight / avail), list(DIMENSIONS)
    ties = [d for d in ties if d in rows.columns]
    down = W.partitionBy(*by).orderBy(ratio.desc_nulls_last(), *[F.col(d).asc() for d in ties]).rowsBetween(W.unboundedPreceding, -1)
    up = W.partitionBy(*by).orderBy(ratio.asc_nulls_first(), *[F.col(d).desc() for d in ties]).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({"_before": F.coalesce(F.sum(avail).over(down), F.lit(0.0)), "_rest": F.sum(weight).over(up)})
    out = out.withColumn("_level", F.when(F.col("_rest") > 0, (total - F.col("_before")) / F.col("_rest")))
    return out.withColumn("_level", F.greatest(F.lit(0.0), F.coalesce(F.max("_level").over(W.partitionBy(*by)), F.lit(0.0)))).drop("_before", "_rest")


def reachable(cells: DataFrame, budget: float) -> DataFrame:
    """Columns ``in_<dimension>``: the tokens that each cell's category is to have in the sample; they sum to the budget."""
    total = cells.agg(F.sum("t")).first()[0] or 0.0
    for d in DIMENSIONS:
        marginal = cells.groupBy(d).agg(F.sum("t").alias("a"), F.max(f"to_{d}").alias("s")).withColumns({"s": F.when(F.col("a") > 0, F.col("s")).otherwise(0.0), "_all": F.lit(0)})
        level = water_level(marginal, ["_all"], F.col("a"), F.col("s"), F.lit(budget * total))
        cells = cells.join(level.select(d, F.least(F.col("a"), F.col("s") * F.col("_level")).alias(f"in_{d}")), d)
    return cells


def rake(cells: DataFrame, budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """Columns ``factor`` (unbounded, 0 without tokens) and ``p`` (at most 1): the expected tokens t * p meet ``in_<dimension>``."""
    out = cut_lineage(reachable(cells, budget).withColumn("factor", F.when(F.col("t") > 0, 1.0).otherwise(0.0)))
    # a small table stays in one partition, so no step of a sweep has to shuffle it
    small = out.count() <= BROADCAST_CELLS
    for _ in range(sweeps):
        out = out.coalesce(1) if small else out
        for d in DIMENSIONS:
            out = water_level(out, [d], F.col("t"), F.col("t") * F.col("factor"), F.col(f"in_{d}"))
            out = out.withColumn("factor", F.col("factor") * F.col("_level")).drop("_level")
        out = cut_lineage(out)
    return out.withColumn("p", F.least(F.lit(1.0), F.col("factor")))


def target_report(raked: DataFrame) -> DataFrame:
    """One row per dimension and category: the shares of the sample's tokens asked for, within reach, and expected."""
    parts = []
    for d in DIMENSIONS:
        sums = raked.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(F.max(f"to_{d}").alias("asked"), F.max(f"in_{d}").alias("reach"), F.sum(F.col("t") * F.col("p")).alias("sampled"))
        every = W.partitionBy("dimension")
        parts.append(sums.select("dimension", "category", "asked", (F.col("reach") / F.sum("reach").over(every)).alias("reachable"), (F.col("sampled") / F.sum("sampled").over(every)).alias("expected")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, temper: float = TEMPER) -> DataFrame:
    """All documents with ``_source``, ``_lang``, ``_topic``, ``_tokens``, ``_factor``, ``_probability`` and ``_kept``."""
    rows = described(documents, text, source, lang)
    cells = cut_lineage(cells_of(rows))
    fitted = cut_lineage(rake(with_targets(cells, targets, temper), budget, sweeps))
    small = fitted.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("factor").alias("_factor"), F.col("p").alias("_probability"))
    if small.count() <= BROADCAST_CELLS:
        small = F.broadcast(small)
    names = [f"_{d}" for d in DIMENSIONS]
    return rows.join(small, names, "left").withColumn("_kept", uniform(F.col(key)) < F.col("_probability"))

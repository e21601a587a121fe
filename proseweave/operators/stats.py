"""Statistical tables: one row per (target, feature), all pairs from one pass over the data.

Sufficient statistics (counts, moments, rank sums) are aggregated with map-side combine; only the
finished table, whose size is targets x features, reaches the tail functions.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tails as T
from .ordered import exact_quantiles, melt, rank_table, with_ranks

METHODS = ("pearson", "spearman", "kendall", "skipped")


def _num(name: str) -> Column:
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over rows with both values, null without variance."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def _rows(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))


# --- groups --------------------------------------------------------------------------------


def group_moments(df: DataFrame, targets: list[str], features: list[str]) -> DataFrame:
    """(x, y, level, n, mean, var): moments of feature y within each level of target x."""
    out = None
    for x in targets:
        aggs = []
        for i, y in enumerate(features):
            v = _num(y)
            aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
        g = df.where(F.col(f"`{x}`").isNotNull()).groupBy(F.col(f"`{x}`").cast("string").alias("level")).agg(*aggs)
        part = g.select(
            F.lit(x).alias("x"),
            "level",
            _rows([F.struct(F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var")) for i, y in enumerate(features)]),
        )
        out = part if out is None else out.unionByName(part)
    return out.select("x", "y", "level", "n", "mean", "var")


def _two_levels(moments: DataFrame, one: str, two: str) -> DataFrame:
    pick = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c))).alias(f"{c}_{'a' if level == one else 'b'}")
    return moments.where(F.col("level").isin(one, two)).groupBy("x", "y").agg(
        *[pick(level, c) for level in (one, two) for c in ("n", "mean", "var")]
    )


def _pooled(t: DataFrame) -> DataFrame:
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / F.nullif(na + nb - 2, F.lit(0)))
    return t.withColumn("sd", F.nullif(pooled, F.lit(0.0))).withColumn("d", (F.col("mean_a") - F.col("mean_b")) / F.col("sd"))


def ttest_table(df: DataFrame, targets: list[str], features: list[str], threshold: float | None = 0.01) -> DataFrame:
    """Equal-variance two-sample t tests, group 0 against group 1 of each binary target."""
    t = _pooled(_two_levels(group_moments(df, targets, features), "0", "1"))
    se = F.col("sd") * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))
    t = t.withColumn("se", se).withColumns({"T": (F.col("mean_a") - F.col("mean_b")) / F.col("se"), "dof": F.col("n_a") + F.col("n_b") - 2})
    t = t.where(F.col("T").isNotNull())

    @F.pandas_udf("p double, low double, high double, bf double, power double")
    def tail(tv: pd.Series, dof: pd.Series, diff: pd.Series, se_: pd.Series, n1: pd.Series, n2: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = []
        for a, k, df_, s, x, y, e in zip(tv, dof, diff, se_, n1, n2, d):
            half = T.t_quantile(0.025, k) * s
            rows.append((T.t_two_sided(a, k), df_ - half, df_ + half, T.bayes_factor_t(a, int(x), int(y)), T.power_two_groups(int(x), int(y), e, 0.05)))
        return pd.DataFrame(rows, columns=["p", "low", "high", "bf", "power"])

    out = t.withColumn("r", tail("T", "dof", F.col("mean_a") - F.col("mean_b"), "se", "n_a", "n_b", "d")).select(
        "x", "y", "T", "dof", F.lit("two-sided").alias("alternative"), F.col("r.p").alias("p_val"), F.col("r.low").alias("ci_low"),
        F.col("r.high").alias("ci_high"), F.abs("d").alias("cohen_d"), F.col("r.bf").alias("BF10"), F.col("r.power").alias("power"),
    )
    return out if threshold is None else out.where(F.col("p_val") <= threshold)


def cohen_table(df: DataFrame, condition: str, one: str, two: str, features: list[str]) -> DataFrame:
    """Cohen's d of every feature between two levels of a condition."""
    return _pooled(_two_levels(group_moments(df, [condition], features), one, two)).select("x", "y", F.col("d").alias("cohen"))


def anova_table(df: DataFrame, targets: list[str], features: list[str], threshold: float | None = 0.01) -> DataFrame:
    """One-way ANOVA: F, p, partial eta squared, power. A failed test has p = 1 and eta 0."""
    m = group_moments(df, targets, features).where("n > 0")
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    # between-group sum of squares around the grand mean, kept stable by a second pass over the groups
    grand = m.groupBy("x", "y").agg(n.alias("total"), (s / n).alias("grand"), F.count(F.lit(1)).alias("k"))
    agg = m.join(F.broadcast(grand), ["x", "y"]).groupBy("x", "y", "total", "k").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"),
    )
    f = (F.col("ssb") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("ssw") / F.nullif(F.col("total") - F.col("k"), F.lit(0)), F.lit(0.0))

    @F.pandas_udf("p double, power double")
    def tail(fv: pd.Series, k: pd.Series, total: pd.Series, eta: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, e in zip(fv, k, total, eta):
            rows.append((1.0, math.nan) if a is None or math.isnan(a) else (T.f_tail(a, b - 1, c - b), T.power_groups(e, int(b), int(c))))
        return pd.DataFrame(rows, columns=["p", "power"])

    eta = F.coalesce(F.when(f.isNotNull(), F.col("ssb") / F.nullif(F.col("ssb") + F.col("ssw"), F.lit(0.0))), F.lit(0.0))
    out = agg.withColumns({"F": f, "np2": eta}).withColumn("r", tail("F", "k", "total", "np2")).select(
        "x", "y", "F", F.col("r.p").alias("p_unc"), "np2", F.nanvl("r.power", F.lit(None).cast("double")).alias("power")
    )
    return out if threshold is None else out.where(F.col("p_unc") <= threshold)


def ranksum_table(df: DataFrame, targets: list[str], features: list[str], threshold: float | None = 0.01, alternative: str = "two-sided") -> DataFrame:
    """Rank-sum z (average ranks, no tie correction), p, Cohen's d and power, group 1 against group 0.

    Group counts per (target, feature, value) meet the rank table of the same pair on the value, so the
    rank sum is built from counted values and never from single rows.
    """
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError("alternative must be two-sided, less or greater")
    long = None
    for x in targets:
        part = melt(df.where(F.col(f"`{x}`").isin(0, 1)), [x], features, "y", "value").select(
            F.concat_ws("\x1f", F.lit(x), "y").alias("feature"), F.lit(x).alias("x"), "y", F.col(f"`{x}`").cast("int").alias("g"), "value"
        )
        long = part if long is None else long.unionByName(part)
    long = long.where("value is not null and not isnan(value)")
    counted = long.groupBy("feature", "x", "y", "value").agg(F.sum("g").alias("ones"))
    ranked = counted.join(rank_table(long).select("feature", "value", "avg_rank", "total"), ["feature", "value"])
    sums = ranked.groupBy("x", "y").agg(F.sum(F.col("ones") * F.col("avg_rank")).alias("r1"), F.sum("ones").alias("n1"), F.max("total").alias("N"))
    # in doubles: the product below leaves a long at a few million rows
    n1, n0 = F.col("n1").cast("double"), (F.col("N") - F.col("n1")).cast("double")
    z = (F.col("r1") - n1 * (F.col("N") + 1) / 2) / F.sqrt(n1 * n0 * (F.col("N") + 1) / 12.0)
    effect = _pooled(_two_levels(group_moments(df, targets, features), "1", "0")).select("x", "y", F.col("d").alias("cohen"))
    t = sums.where((n1 > 0) & (n0 > 0)).withColumn("stats", z).join(effect, ["x", "y"])

    @F.pandas_udf("p double, power double")
    def tail(zv: pd.Series, a: pd.Series, b: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = []
        for v, x, y, e in zip(zv, a, b, d):
            two = T.norm_two_sided(v)
            upper = two / 2 if v > 0 else 1 - two / 2
            p = two if alternative == "two-sided" else upper if alternative == "greater" else 1 - upper
            rows.append((p, T.power_two_groups(int(x), int(y), e, 0.01)))
        return pd.DataFrame(rows, columns=["p", "power"])

    out = t.withColumn("r", tail("stats", n1, n0, "cohen")).select("x", "y", "stats", F.col("r.p").alias("pval"), "cohen", F.col("r.power").alias("power"))
    return out if threshold is None else out.where(F.col("pval") <= threshold)


# --- correlation ---------------------------------------------------------------------------


def _pair_rows(df: DataFrame, pairs: list[tuple[str, str]], cols: dict[str, Column]) -> DataFrame:
    aggs = []
    for i, (x, y) in enumerate(pairs):
        both = cols[x].isNotNull() & cols[y].isNotNull()
        aggs += [safe_corr(cols[x], cols[y]).alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    clean = lambda r: F.when(~F.isnan(r), r)
    return df.agg(*aggs).select(
        _rows([F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), clean(F.col(f"r{i}")).alias("r")) for i, (x, y) in enumerate(pairs)])
    )


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, n, r): all pairs in one aggregate, rows complete for the pair."""
    return _pair_rows(df, pairs, {c: _num(c) for c in {c for p in pairs for c in p}})


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Spearman's r. Ranks are taken over the rows complete for the pair; columns without missing
    values share one ranking."""
    columns = sorted({c for p in pairs for c in p})
    missing = df.agg(*[F.count(F.when(_num(c).isNull(), 1)).alias(c) for c in columns]).first()
    full = [p for p in pairs if not missing[p[0]] and not missing[p[1]]]
    holes = [p for p in pairs if p not in full]
    parts = []
    if full:
        used = sorted({c for p in full for c in p})
        base = df.select(*[_num(c).alias(c) for c in used])
        ranked = with_ranks(base, {c: f"_rank_{c}" for c in used})
        parts.append(_pair_rows(ranked, full, {c: F.col(f"`_rank_{c}`") for c in used}))
    for x, y in holes:
        base = df.select(_num(x).alias("x"), _num(y).alias("y")).where("x is not null and y is not null")
        ranked = with_ranks(base, {"x": "rx", "y": "ry"})
        r = _pair_rows(ranked, [("x", "y")], {"x": F.col("rx"), "y": F.col("ry")})
        parts.append(r.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", F.when(F.col("n") >= 3, F.col("r")).alias("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Kendall's tau-b in O(N log N) work without pairing rows.

    Equal (x, y) rows are counted first. With y ranked densely from 0, every binary digit of the rank
    splits the rows that agree on all higher digits: a 1 after a 0 in x order is a concordant pair, a 0
    after a 1 a discordant one. Each digit is a running count inside (digit, higher digits), so the whole
    table is a grouped running sum. Only ``(group, x bucket)`` is sorted by one task. ``s`` is the score
    (concordant less discordant pairs) and ``var_s`` its variance under independence, corrected for ties.
    """
    long = None
    for i, (x, y) in enumerate(pairs):
        part = df.select(F.lit(i).alias("p"), _num(x).alias("x"), _num(y).alias("y")).where("x is not null and y is not null")
        long = part if long is None else long.unionByName(part)
    cells = long.groupBy("p", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    both = rank_table(
        cells.select(F.explode(F.array(F.struct(F.concat(F.lit("x"), "p").alias("feature"), F.col("x").alias("value")), F.struct(F.concat(F.lit("y"), "p").alias("feature"), F.col("y").alias("value")))).alias("c")).select("c.*").distinct()
    )  # distinct values, so ``before`` is the dense rank
    side = lambda s: both.where(F.substring("feature", 1, 1) == s).select(
        F.substring("feature", 2, 9).cast("int").alias("p"), F.col("value").alias(s), F.col("before").alias(f"r{s}"), F.col("total").alias(f"t{s}")
    )
    c = cells.join(side("x"), ["p", "x"]).join(side("y"), ["p", "y"])
    bits = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.col("ty"), F.lit(2)).cast("double"))), F.lit(1)).cast("int") - 1)
    digits = c.select("p", "rx", "tx", "ry", "n", F.explode(bits).alias("bit"))
    high, one = F.expr("shiftright(ry, bit + 1)"), F.expr("shiftright(ry, bit) & 1L")
    grouped = digits.select(
        "p", "bit", high.alias("h"), "rx", "tx", F.when(one == 1, F.col("n")).otherwise(0).alias("n1"), F.when(one == 0, F.col("n")).otherwise(0).alias("n0")
    ).groupBy("p", "bit", "h", "rx", "tx").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    bucket = F.floor(F.col("rx") / 65536)  # distinct values of x in one task, at any size
    b = grouped.withColumn("b", bucket)
    inner = W.partitionBy("p", "bit", "h", "b").orderBy("rx").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("p", "bit", "h").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0))
    totals = b.groupBy("p", "bit", "h", "b").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
    offs = totals.select("p", "bit", "h", "b", zero(F.sum("s0").over(outer)).alias("o0"), zero(F.sum("s1").over(outer)).alias("o1"))
    run = b.withColumns({"b0": zero(F.sum("n0").over(inner)), "b1": zero(F.sum("n1").over(inner))}).join(offs, ["p", "bit", "h", "b"])
    d = lambda e: e.cast("double")
    score = run.groupBy("p").agg(
        F.sum(d(F.col("n1")) * (F.col("b0") + F.col("o0")) - d(F.col("n0")) * (F.col("b1") + F.col("o1"))).alias("s")
    )
    m = d(F.col("m"))
    tied = lambda k: cells.groupBy("p", k).agg(F.sum("n").alias("m")).groupBy("p").agg(
        F.sum("m").alias("N"), F.sum(m * (m - 1) / 2).alias(f"t_{k}"), F.sum(m * (m - 1) * (m - 2)).alias(f"u_{k}"), F.sum(m * (m - 1) * (2 * m + 5)).alias(f"v_{k}")
    )
    t = score.join(tied("x"), "p").join(tied("y").drop("N"), "p")
    # variance of the score under independence, corrected for ties
    big = d(F.col("N"))
    pairs_n = big * (big - 1)
    var = (pairs_n * (2 * big + 5) - F.col("v_x") - F.col("v_y")) / 18 + 2 * F.col("t_x") * F.col("t_y") / F.nullif(pairs_n, F.lit(0.0)) + F.coalesce(
        F.col("u_x") * F.col("u_y") / (9 * F.nullif(pairs_n * (big - 2), F.lit(0.0))), F.lit(0.0)
    )
    whole = d(F.col("N")) * (F.col("N") - 1) / 2
    tau = F.col("s") / F.sqrt(F.nullif((whole - F.col("t_x")) * (whole - F.col("t_y")), F.lit(0.0)))
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("p") + 1)
    return t.select(name(0).alias("x"), name(1).alias("y"), F.col("N").alias("n"), tau.alias("r"), "s", var.alias("var_s"), (F.col("t_x") + F.col("t_y") > 0).alias("ties"))


def outlier_flags(df: DataFrame, x: str, y: str, directions: int = 16) -> DataFrame:
    """Rows of a pair with ``outlier``: projected on fixed directions around the coordinate medians and
    compared with median + sqrt(chi2_{2, .975}) * MAD / 0.6745 of each direction."""
    base = df.select("*", _num(x).alias("_x"), _num(y).alias("_y")).where("_x is not null and _y is not null")
    mid = {r["feature"]: r["m"] for r in exact_quantiles(melt(base, [], ["_x", "_y"]), {"m": 0.5}).collect()}
    proj = {}
    for k in range(directions):
        a = math.pi * k / directions
        proj[f"_p{k}"] = F.abs((F.col("_x") - mid["_x"]) * math.cos(a) + (F.col("_y") - mid["_y"]) * math.sin(a))
    p = base.withColumns(proj)
    # distances to the centre: median and median absolute deviation per direction (two exact quantile passes)
    med = {r["feature"]: r["m"] for r in exact_quantiles(melt(p, [], list(proj)), {"m": 0.5}).collect()}
    dev = p.select(*[F.abs(F.col(c) - med[c]).alias(c) for c in proj])
    mad = {r["feature"]: r["m"] for r in exact_quantiles(melt(dev, [], list(proj)), {"m": 0.5}).collect()}
    cut = math.sqrt(7.377758908227871)
    flag = F.lit(False)
    for c in proj:
        flag = flag | (F.col(c) > med[c] + cut * mad[c] / 0.6745)
    return p.withColumn("outlier", flag).drop(*proj, "_x", "_y")


def skipped_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Spearman's r after dropping projection outliers of each pair."""
    out = None
    for x, y in pairs:
        kept = outlier_flags(df.select(x, y), x, y).where(~F.col("outlier"))
        part = spearman_pairs(kept, [(x, y)])
        out = part if out is None else out.unionByName(part)
    return out


def correlate(df: DataFrame, pairs: list[tuple[str, str]], method: str = "pearson") -> DataFrame:
    run = {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs, "skipped": skipped_pairs}
    if method not in run:
        raise ValueError(f"unknown correlation {method!r}; choose from {METHODS}")
    return run[method](df, pairs)


def correlation_table(df: DataFrame, targets: list[str], features: list[str], threshold: float | None = 0.01, method: str = "pearson") -> DataFrame:
    """n, r, 95% interval, p, BF10 and power for each (target, feature). A pair that cannot be computed
    has null statistics and a text in ``error``; with a threshold it is left out."""
    t = correlate(df, [(x, y) for x in targets for y in features], method)
    if method != "kendall":
        t = t.withColumns({"s": F.lit(None).cast("double"), "var_s": F.lit(None).cast("double"), "ties": F.lit(False)})

    @F.pandas_udf("low double, high double, p double, bf double, power double")
    def tail(r: pd.Series, n: pd.Series, s: pd.Series, var: pd.Series, ties: pd.Series) -> pd.DataFrame:
        rows = []
        for v, k, score, spread, tied in zip(r, n, s, var, ties):
            k = int(k)
            if v is None or math.isnan(v) or k < 3:
                rows.append((None,) * 5)
                continue
            low, high = T.fisher_interval(v, k, T.norm_quantile(0.975))
            if method == "kendall":
                p = T.kendall_two_sided(score, spread, k, bool(tied))
            else:
                p = 0.0 if abs(v) >= 1 else T.t_two_sided(v * math.sqrt((k - 2) / (1 - v * v)), k - 2)
            bf = T.bayes_factor_correlation(v, k) if method == "pearson" else None
            rows.append((low, high, p, bf, T.power_correlation(v, k)))
        return pd.DataFrame(rows, columns=["low", "high", "p", "bf", "power"], dtype=float)

    null = lambda c: F.nanvl(F.col(f"t.{c}"), F.lit(None).cast("double"))
    out = t.withColumn("t", tail("r", "n", "s", "var_s", "ties")).select(
        "x", "y", "n", "r", null("low").alias("ci_low"), null("high").alias("ci_high"), null("p").alias("p_val"), null("bf").alias("BF10"), null("power").alias("power"),
        F.when(F.col("r").isNull(), "no variance or too few rows").alias("error"),
    )
    return out if threshold is None else out.where(F.col("p_val") <= threshold)


def adjust_bh(df: DataFrame, p: str = "p_val", out: str = "adjusted_p_value", within: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg step-up over the rows with a p-value; rows without keep null. The table has one
    row per test, so one window task is enough."""
    part = within or []
    known = df.where(F.col(p).isNotNull())
    m = F.count(F.lit(1)).over(W.partitionBy(*part))
    rank = F.row_number().over(W.partitionBy(*part).orderBy(p))
    scaled = known.withColumn("_q", F.col(p) * m / rank)
    running = W.partitionBy(*part).orderBy(F.desc(p), F.desc("_q")).rowsBetween(W.unboundedPreceding, 0)
    done = scaled.withColumn(out, F.least(F.min("_q").over(running), F.lit(1.0))).drop("_q")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def adjusted_table(df: DataFrame, targets: list[str], features: list[str], methods: list[str] = ("spearman",)) -> DataFrame:
    """Correlations of several methods with BH-adjusted p and the Fisher interval whose width uses the
    normal quantile of the adjusted p (not a 95% interval; kept as the analysis defines it)."""
    out = None
    for m in methods:
        part = correlation_table(df, targets, features, None, m).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    adj = adjust_bh(out)

    @F.pandas_udf("low double, high double")
    def interval(r: pd.Series, n: pd.Series, q: pd.Series) -> pd.DataFrame:
        rows = []
        for v, k, a in zip(r, n, q):
            ok = v is not None and a is not None and not math.isnan(v) and not math.isnan(a)
            rows.append(T.fisher_interval(v, int(k), T.norm_quantile(1 - a / 2)) if ok else (None, None))
        return pd.DataFrame(rows, columns=["low", "high"], dtype=float)

    return adj.withColumn("i", interval("r", "n", "adjusted_p_value")).withColumns({"ci_low_adj": F.col("i.low"), "ci_high_adj": F.col("i.high")}).drop("i")


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r, strength, distance) for every ordered pair; strength = |r|, distance = 1 - |r|."""
    half = correlate(df, list(combinations(columns, 2)), method)
    both = half.select(
        _rows([F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("r")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("r"))])
    )
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return both.unionByName(diag).withColumns({"strength": F.abs("r"), "distance": 1 - F.abs("r")})


def reliability(paired: DataFrame, features: dict[str, tuple[str, str]], method: str = "pearson", least_r: float = 0.05, most_p: float = 0.1) -> DataFrame:
    """Correlation of every feature across two conditions with p, BH-adjusted p and ``reliable``: |r| above
    ``least_r`` and adjusted p below ``most_p``; strongest first, nulls last."""
    names = {pair: f for f, pair in features.items()}
    parts = [correlation_table(paired, [a], [b], None, method).withColumn("feature", F.lit(names[a, b])) for a, b in features.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    done = adjust_bh(out.select("feature", "n", "r", "p_val"))
    reliable = F.coalesce((F.abs("r") > least_r) & (F.col("adjusted_p_value") < most_p), F.lit(False))
    return done.withColumn("reliable", reliable).orderBy(F.desc_nulls_last("r"), "feature")


# --- agreement -----------------------------------------------------------------------------


def icc_table(paired: DataFrame, features: dict[str, tuple[str, str]]) -> DataFrame:
    """Agreement ICC(2,1) of two measurements per subject. ``features`` maps a name to its two columns.

    Needs three complete pairs and some variance; otherwise the row is left out. Mean squares come from
    the moments of the row sum and the row difference, in one aggregate.
    """
    aggs = []
    for i, (a, b) in enumerate(features.values()):
        fin = lambda c: F.when(F.abs(_num(c)) != float("inf"), _num(c))
        ok = fin(a).isNotNull() & fin(b).isNotNull()
        s, d = F.when(ok, fin(a) + fin(b)), F.when(ok, fin(a) - fin(b))
        aggs += [F.count(s).alias(f"n{i}"), F.var_samp(s).alias(f"s{i}"), F.var_samp(d).alias(f"d{i}"), F.avg(d).alias(f"m{i}")]
    rows = paired.agg(*aggs).select(
        _rows([F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("vs"), F.col(f"d{i}").alias("vd"), F.col(f"m{i}").alias("md")) for i, f in enumerate(features)])
    )
    # k = 2: MSR = var(a+b)/2, MSE = var(a-b)/2, MSC = n * mean(a-b)^2 / 2
    ms = rows.where("n >= 3 and vs + vd > 0").withColumns(
        {"msr": F.col("vs") / 2, "mse": F.col("vd") / 2, "msc": F.col("n") * F.col("md") ** 2 / 2}
    )
    icc = (F.col("msr") - F.col("mse")) / (F.col("msr") + F.col("mse") + 2 * (F.col("msc") - F.col("mse")) / F.col("n"))
    out = ms.withColumns({"icc": icc, "F": F.col("msr") / F.nullif(F.col("mse"), F.lit(0.0))})

    @F.pandas_udf("low double, high double, p double")
    def tail(r: pd.Series, c: pd.Series, e: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows_ = []
        for a, b, x, k in zip(r, c, e, n):
            if x > 0:
                rows_.append((*T.agreement_interval(a, b, x, int(k), 2), T.f_tail(a / x, k - 1, k - 1)))
            else:
                rows_.append((1.0, 1.0, 0.0))
        return pd.DataFrame(rows_, columns=["low", "high", "p"])

    band = F.when(F.col("icc") < 0.5, "poor").when(F.col("icc") < 0.75, "moderate").when(F.col("icc") < 0.9, "good").otherwise("excellent")
    done = out.withColumn("t", tail("msr", "msc", "mse", "n")).select(
        "feature", "n", "icc", "F", F.col("t.low").alias("ci_low"), F.col("t.high").alias("ci_high"), F.col("t.p").alias("p_val"), band.alias("interpretation")
    )
    return adjust_bh(done)


def icc_summary(icc: DataFrame, cut: float = 0.5) -> DataFrame:
    """Number of features per interpretation, and how many pass the cut."""
    return icc.groupBy("interpretation").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("icc") > cut).cast("int")).alias("selected"))


# --- scaling -------------------------------------------------------------------------------


def robust_scale(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(x - median) / IQR with exact quartiles, overall or within each level of ``by``. The quartile table
    has one row per level and column; rows without a level are a level of their own."""
    g = F.col(by).cast("string") if by else F.lit("all")
    base = df.withColumn("_g", g)
    long = melt(base, ["_g"], columns).select(F.struct("_g", "feature").alias("feature"), "value")
    q = exact_quantiles(long, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = q.select(F.col("feature._g").alias("_level"), F.col("feature.feature").alias("_c"), "q1", "q2", "q3").groupBy("_level").pivot("_c", columns).agg(
        F.first("q2").alias("mid"), F.first(F.col("q3") - F.col("q1")).alias("iqr")
    )
    joined = base.join(wide, F.col("_g").eqNullSafe(F.col("_level")), "left")
    scaled = {c: (F.col(f"`{c}`") - F.col(f"`{c}_mid`")) / F.nullif(F.col(f"`{c}_iqr`"), F.lit(0.0)) for c in columns}
    return joined.withColumns(scaled).select(df.columns)


def shift_non_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """x + |min x| per column."""
    low = df.agg(*[F.min(_num(c)).alias(c) for c in columns]).select(F.struct("*").alias("s")).scalar()
    return df.withColumns({c: F.col(f"`{c}`") + F.abs(low[c]) for c in columns})

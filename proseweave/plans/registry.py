"""All registered queries and the SQL statements they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density as N
from ..operators import distances as D
from . import composition_queries, corpus_queries, distance_queries, model_queries, stat_queries, text_queries
from . import views as V

FAMILIES = (text_queries, distance_queries, corpus_queries, stat_queries, model_queries, composition_queries)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """One row per story: all-pairs distance summary, mean consecutive distance, narrative speed."""
    vectors = V.story_vectors(spark, d)
    steps = D.consecutive(vectors).groupBy("story_id").agg(F.avg("d").alias("consecutive_mean"))
    pairs = D.pair_summary(vectors)
    speed = N.narrative_speed(vectors).select("story_id", "n", "speed")
    out = pairs.join(steps, "story_id", "left").join(speed, "story_id")
    return out.select("story_id", "n", *[F.round(c, 6).alias(c) for c in (*D.STATS, "consecutive_mean", "speed")])


def queries() -> dict:
    out = {"story_profile": flagship}
    for family in FAMILIES:
        out |= family.QUERIES
    return out


def oracles() -> dict[str, str]:
    out = {"story_profile": _PROFILE}
    for family in FAMILIES:
        out |= family.ORACLES
    return out


_PROFILE = f"""WITH {distance_queries._PAIR},
n AS (SELECT story_id, count(*) AS n FROM sv GROUP BY story_id),
st AS (SELECT story_id, i AS step, d FROM pr WHERE j = i + 1),
m AS (SELECT *, count(*) OVER (PARTITION BY story_id) AS m, lead(d) OVER (PARTITION BY story_id ORDER BY step) AS nx FROM st),
g AS (SELECT story_id, m, d, CASE WHEN step = 0 THEN nx WHEN step = m - 1 THEN d ELSE (d + nx) / 2 END AS g FROM m),
sp AS (SELECT story_id, avg(d) AS cm, CASE WHEN max(m) <= 2 THEN 0 ELSE 2 * sum(abs(g)) / max(m) END AS speed FROM g GROUP BY story_id),
ps AS (SELECT story_id, avg(d) AS mean, quantile_cont(d, 0.5) AS median, stddev_pop(d) AS std, min(d) AS min, max(d) AS max FROM pr GROUP BY story_id)
SELECT story_id, n, round(coalesce(mean, 1), 6) AS mean, round(coalesce(median, 1), 6) AS median, round(coalesce(std, 0), 6) AS std,
  round(coalesce(min, 1), 6) AS min, round(coalesce(max, 1), 6) AS max, round(cm, 6) AS consecutive_mean, round(coalesce(speed, 0), 6) AS speed
FROM n LEFT JOIN ps USING (story_id) LEFT JOIN sp USING (story_id)"""

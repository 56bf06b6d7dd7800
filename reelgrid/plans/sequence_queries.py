"""Queries over sequences whose decisions depend on earlier ones, and over states that are merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prefix, segment
from . import views as V
from .catalogue import _threshold
from .registry import query

c = F.col

#: One step of the causal detector over |score - score before|, and of the blend, which starts anew at a cut.
_SHOTS = f"""WITH RECURSIVE {V.SCORES}, r AS (
  SELECT clip, 0::BIGINT AS idx, score, []::DOUBLE[] AS w, []::DOUBLE[] AS l, 1073741824::BIGINT AS since, false AS cut, score AS v FROM scores WHERE idx = 0
  UNION ALL
  SELECT clip, idx, score, w, list_sort(w) AS l, since, cut, CASE WHEN cut THEN score ELSE a * v0 + (1 - a) * score END AS v FROM (
    SELECT clip, idx, score, v0, cut, greatest(0::DOUBLE, 1 - abs(score - v0) * (1 / 60.0::DOUBLE)) * 0.6::DOUBLE AS a,
      CASE WHEN cut THEN w0 ELSE list_slice(list_append(w0, CASE WHEN warm THEN d ELSE least(d, t) END), greatest(1, len(w0) + 1 - {{size}} + 1), len(w0) + 1) END AS w, CASE WHEN cut THEN 0 ELSE since0 + 1 END AS since FROM (
      SELECT *, coalesce(NOT warm AND d > t AND since0 >= 6, false) AS cut FROM (
        SELECT s.clip, s.idx, s.score, abs(s.score - r.score) AS d, r.v AS v0, r.w AS w0, r.since AS since0, len(r.w) < 12 AS warm, {_threshold("l", 1.0, "tail")} AS t FROM r JOIN scores s ON s.clip = r.clip AND s.idx = r.idx + 1)))
) SELECT clip, idx, cut, round(v, 6) AS v FROM r"""


@query(_SHOTS.format(size=48))
def shot_reset_blend(spark, sf):
    """Detector and stabiliser together, as planes of one sample; the stream in streaming/stateful.py gives the same rows (tests)."""
    return segment.shot_blended(V.scores(spark, sf), 0.6, 60.0, k=1.0).withColumn("v", F.round("v", 6))


@query(f"""WITH {V.SCORES}, s AS (SELECT clip, score FROM scores), o AS (SELECT clip, list_sort(list(score)) AS l, avg(score) AS m FROM s GROUP BY clip)
SELECT clip, round(m, 6) AS mean, l[1] AS minimum, l[CAST(floor((len(l) - 1) * 0.1::DOUBLE) AS BIGINT) + 1] AS p10, len(l) AS n FROM o""")
def merged_score_states(spark, sf):
    """Four passes over a clip's frames (every fourth frame each), aggregated from their merged states; no score is read twice."""
    scores = V.scores(spark, sf)
    passes = [prefix.states(scores.where(c("idx") % 4 == k), ["clip"], "score") for k in range(4)]
    return score_summary(prefix.merged(*passes, by=["clip"], value="score"))


def score_summary(state):
    """mean, minimum, p10 at the floored index and n of a state."""
    placed = prefix.order_statistics(state, ["clip"], "score", {"minimum": F.lit(0), "p10": F.floor((c("total") - 1) * 0.1)})
    means = state.groupBy(c("clip").alias("_clip")).agg(F.round(F.sum(c("score") * c("n")) / F.sum("n"), 6).alias("mean"))
    return placed.join(means, c("clip").eqNullSafe(c("_clip"))).select("clip", "mean", "minimum", "p10", c("total").alias("n"))


@query(f"WITH {V.SCORES}, o AS (SELECT clip // 10 AS clip, list_sort(list(score)) AS l FROM scores GROUP BY clip // 10) SELECT clip, round(list_avg(l), 6) AS mean, l[1] AS minimum, l[CAST(floor((len(l) - 1) * 0.1::DOUBLE) AS BIGINT) + 1] AS p10, len(l) AS n FROM o")
def rolled_up_score_states(spark, sf):
    """States of clips rolled up to states of shows, ten clips each: the same percentiles as from all scores."""
    clips = prefix.states(V.scores(spark, sf), ["clip"], "score")
    shows = prefix.merged(clips.withColumn("clip", F.floor(c("clip") / 10)), by=["clip"], value="score")
    return score_summary(shows)

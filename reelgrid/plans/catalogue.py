"""The queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import planes as P
from ..operators import policy, sampling, search, segment
from ..operators import spans as S
from . import views as V
from .registry import QUERIES, SQL, query

c = F.col


# ---- spans

MERGED = f"""WITH {V.SPANS}, o AS (
  SELECT lane, start_ns, start_ns + dur_ns AS end_ns FROM spans
), f AS (
  SELECT *, CASE WHEN max(end_ns) OVER (PARTITION BY lane ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_ns THEN 0 ELSE 1 END AS new FROM o
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY lane ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS island FROM f
), m AS (SELECT lane, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM g GROUP BY lane, island)
"""


@query(f"WITH {V.SPANS} SELECT name, arg_min(lane, seq) AS lane, count(*) AS n, round(sum(dur_ns) / 1e9, 6) AS total_s, min(dur_ns / 1e9) AS min_s, max(dur_ns / 1e9) AS max_s, round(sum(dur_ns) / 1e9 / count(*), 6) AS mean_s FROM spans GROUP BY name")
def span_aggregate(spark, sf):
    return S.aggregate(V.spans(spark, sf))


@query(f"WITH {V.SPANS} SELECT coalesce((max(start_ns + dur_ns) - min(start_ns)) / 1e9, 0) AS timeline_s FROM spans")
def timeline_seconds(spark, sf):
    return S.timeline(V.spans(spark, sf))


@query(MERGED + "SELECT * FROM m")
def merge_intervals(spark, sf):
    return S.merged(V.spans(spark, sf))


@query(MERGED + ", t AS (SELECT (max(start_ns + dur_ns) - min(start_ns)) / 1e9 AS wall FROM spans), b AS (SELECT lane, sum(end_ns - start_ns) / 1e9 AS busy FROM m GROUP BY lane) SELECT lane, round(busy, 6) AS busy_s, round(busy / wall, 9) AS utilization FROM b, t WHERE wall > 0")
def lane_utilization(spark, sf):
    return S.lane_utilization(V.spans(spark, sf))


@query(f"WITH {V.SPANS} SELECT detail, count(*) AS n FROM spans WHERE detail <= 1 GROUP BY detail")
def detail_filter(spark, sf):
    return S.detailed(V.spans(spark, sf), 1).groupBy("detail").agg(F.count("*").alias("n"))


@query(f"WITH {V.SPANS}, k AS (SELECT seq FROM spans ORDER BY seq LIMIT 700) SELECT count(*) AS kept, max(seq) AS last_seq, (SELECT count(*) FROM spans) - count(*) AS dropped FROM k")
def span_cap(spark, sf):
    return S.capped(V.spans(spark, sf), 700)


@query(f"""WITH {V.SPANS}, a AS (SELECT name, count(*) AS n, round(sum(dur_ns) / 1e9, 6) AS total_s, round(sum(dur_ns) / 1e9 / count(*), 6) AS mean_s, min(dur_ns / 1e9) AS min_s, max(dur_ns / 1e9) AS max_s FROM spans GROUP BY name)
SELECT name, n, total_s, format('{{:<34s}} {{:6d}} {{:10.3f}} {{:9.1f}} {{:9.1f}} {{:9.1f}}', name, n, total_s, mean_s * 1000, min_s * 1000, max_s * 1000) AS line FROM a ORDER BY total_s DESC, name LIMIT 20""")
def summary_top20(spark, sf):
    return S.summary(V.spans(spark, sf)).select("name", "n", "total_s", "line")


@query(f"""WITH {V.SPANS} SELECT seq, '{{"attrs":' || CASE WHEN seq % 4 = 0 THEN '{{}}' ELSE '{{"user":"' || tid || '"}}' END || ',"lane":"' || lane || '","name":"' || name || '","t":"span","tid":' || tid || '}}' AS line FROM spans""")
def span_ndjson(spark, sf):
    """Without the two times, whose decimal text differs between engines."""
    return S.ndjson(V.spans(spark, sf)).select("seq", F.regexp_replace("line", '"(durS|startS)":[^,]*,', "").alias("line"))


@query(f"""WITH {V.SPANS}, l AS (SELECT lane, row_number() OVER (ORDER BY min(seq)) AS tid FROM spans GROUP BY lane)
SELECT 'M' AS ph, 'thread_name' AS name, NULL AS cat, tid, NULL::DOUBLE AS ts, NULL::DOUBLE AS dur, '{{"name":"' || lane || '"}}' AS args FROM l
UNION ALL SELECT 'X', name, lane, l.tid, start_ns / 1000.0, dur_ns / 1000.0, CASE WHEN seq % 4 <> 0 THEN '{{"user":"' || spans.tid || '"}}' END FROM spans JOIN l USING (lane)""")
def chrome_trace(spark, sf):
    return S.chrome_trace(V.spans(spark, sf))


# ---- sampling and pairing


@query(f"WITH {V.SCORES} SELECT clip, round(avg(score), 9) AS mean, min(score) AS minimum, quantile_disc(score, 0.1) AS p10, count(*) AS n FROM scores GROUP BY clip")
def video_aggregate_p10(spark, sf):
    return sampling.score_aggregate(V.scores(spark, sf), ["clip"])


@query(f"WITH {V.SCORES}, s AS (SELECT clip, idx, score, row_number() OVER (PARTITION BY clip ORDER BY idx) AS k FROM scores WHERE idx >= 2 AND (idx - 2) % 3 = 0) SELECT clip, idx, score FROM s WHERE k <= 16")
def stride_sample(spark, sf):
    return sampling.strided(V.scores(spark, sf), 3, 2, 16).select("clip", "idx", "score")


@query(f"WITH {V.PROFILES} SELECT id, greatest(1, CAST(round(CASE WHEN fps > 0 THEN fps ELSE 30 END * (w / 100.0)) AS BIGINT)) AS frames, greatest(1, greatest(1, CAST(round(CASE WHEN fps > 0 THEN fps ELSE 30 END * (w / 100.0)) AS BIGINT)) // 12) AS stride FROM profiles")
def adaptive_stride(spark, sf):
    n = sampling.frame_count(c("fps"), c("w") / 100.0)
    return V.profiles(spark, sf).select("id", n.alias("frames"), sampling.stride_for(n).alias("stride"))


@query(f"""WITH {V.SCORES}, u AS (SELECT clip, idx, score FROM scores WHERE idx % 4 = 0 AND idx < 64 UNION ALL SELECT clip, idx, score FROM scores WHERE idx >= 2 AND (idx - 2) % 4 = 0 AND idx < 66)
SELECT clip, round(avg(score), 9) AS mean, min(score) AS minimum, quantile_disc(score, 0.1) AS p10, count(*) AS n FROM u GROUP BY clip""")
def near_gate_merge(spark, sf):
    return sampling.score_aggregate(sampling.refined(V.scores(spark, sf), 4, 16), ["clip"])


@query(f"WITH {V.SCORES}, a AS (SELECT clip, quantile_disc(score, 0.1) AS p10 FROM scores WHERE idx % 4 = 0 AND idx < 64 GROUP BY clip) SELECT clip, p10 FROM a WHERE abs(p10 - 5) < 1.5")
def near_gate(spark, sf):
    return sampling.near_gate(sampling.score_aggregate(sampling.strided(V.scores(spark, sf), 4, 0, 16), ["clip"]), 5.0, stride=4).select("clip", "p10")


def _numbered(spark, sf, kind):
    own = F.row_number().over(sampling.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return V.table(spark, sf, "events").where(c("event_type") == kind).select(c("user_id").alias("clip"), own.alias("idx"), c("value").alias("score"))


_STREAM = "SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS score FROM events WHERE event_type = "


@query(f"WITH a AS ({_STREAM}'click'), b AS ({_STREAM}'view') SELECT a.clip, a.idx, a.score AS a, b.score AS b FROM a JOIN b USING (clip, idx)")
def positional_pair(spark, sf):
    return sampling.positional(_numbered(spark, sf, "click"), _numbered(spark, sf, "view"))


@query("""WITH r AS (SELECT event_id AS ref_id, epoch_us(ts) AS pts FROM events WHERE event_type = 'click'), o AS (SELECT event_id AS other_id, epoch_us(ts) AS pts FROM events WHERE event_type = 'view'),
j AS (SELECT ref_id, r.pts AS ref_pts, other_id, o.pts AS other_pts, row_number() OVER (PARTITION BY ref_id ORDER BY abs(r.pts - o.pts), o.pts DESC, other_id DESC) AS k FROM r JOIN o ON abs(r.pts - o.pts) <= 300000000)
SELECT ref_id, ref_pts, other_id, other_pts FROM j WHERE k = 1""")
def nearest_pts_pair(spark, sf):
    e = V.table(spark, sf, "events")
    side = lambda kind, name: e.where(c("event_type") == kind).select(c("event_id").alias(name), V.micros("ts").alias("pts"))
    return sampling.nearest(side("click", "ref_id"), side("view", "other_id"), 300_000_000)


@query("""WITH r AS (SELECT event_id AS ref_id, user_id AS clip, epoch_us(ts) AS pts FROM events WHERE event_type = 'click' QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 = 0), o AS (SELECT user_id AS clip, epoch_us(ts) AS pts FROM events WHERE event_type = 'view'),
m AS (SELECT DISTINCT ref_id FROM r JOIN o ON r.clip = o.clip AND abs(r.pts - o.pts) <= 43200000000), h AS (SELECT clip, pts, r.ref_id, m.ref_id IS NOT NULL AS hit FROM r LEFT JOIN m ON m.ref_id = r.ref_id),
n AS (SELECT clip, hit, coalesce(sum(hit::INT) OVER (PARTITION BY clip ORDER BY pts NULLS LAST, ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM h)
SELECT clip, count_if(hit)::BIGINT AS matched, count_if(NOT hit)::BIGINT AS skipped FROM n WHERE n < 3 GROUP BY clip""")
def pairing_counts(spark, sf):
    """Every second click of a user with that user's nearest view, within half a day; three matches at most."""
    e = V.table(spark, sf, "events")
    side = lambda kind, name: e.where(c("event_type") == kind).select(c("event_id").alias(name), V.micros("ts").alias("pts"), c("user_id").alias("clip"))
    place = F.row_number().over(sampling.Window.partitionBy("clip").orderBy("pts", "ref_id")) - 1
    references = sampling.strided(side("click", "ref_id").withColumn("idx", place), 2, 0, 1 << 40).drop("idx")
    return sampling.matched(references, sampling.nearest(references, side("view", "other_id"), 43_200_000_000, ["clip"]), 3)


@query("""WITH r AS (SELECT event_id AS ref_id, user_id AS clip, epoch_us(ts) AS pts FROM events WHERE event_type = 'click'), o AS (SELECT event_id AS other_id, user_id AS clip, epoch_us(ts) AS pts FROM events WHERE event_type = 'view'),
j AS (SELECT r.clip, ref_id, r.pts AS ref_pts, other_id, o.pts AS other_pts, row_number() OVER (PARTITION BY ref_id ORDER BY abs(r.pts - o.pts), o.pts DESC, other_id DESC) AS k FROM r JOIN o ON r.clip = o.clip AND abs(r.pts - o.pts) <= 43200000000)
SELECT clip, ref_id, ref_pts, other_id, other_pts FROM j WHERE k = 1""")
def nearest_in_clip(spark, sf):
    e = V.table(spark, sf, "events")
    side = lambda kind, name: e.where(c("event_type") == kind).select(c("event_id").alias(name), V.micros("ts").alias("pts"), c("user_id").alias("clip"))
    return sampling.nearest(side("click", "ref_id"), side("view", "other_id"), 43_200_000_000, ["clip"])


@query(f"WITH {V.SCORES} SELECT clip, idx, coalesce(array_to_string(list(idx) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), ','), '') AS \"before\", coalesce(array_to_string(list(idx) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS \"after\" FROM scores")
def neighbour_window(spark, sf):
    joined = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return sampling.neighbours(V.scores(spark, sf).select("clip", "idx"), "idx").select("clip", "idx", joined("before").alias("before"), joined("after").alias("after"))


@query("SELECT id, unnest(CASE WHEN n > 0 THEN list_distinct([0, n - 1]) ELSE [] END)::BIGINT AS frame FROM (SELECT o_orderkey AS id, o_orderkey % 4 AS n FROM orders)")
def check_frames(spark, sf):
    return V.table(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.explode(sampling.check_frames(c("o_orderkey") % 4)).alias("frame"))


@query(f"WITH {V.SCORES} SELECT clip, round(avg(score), 6) AS probe, avg(score) < 90 AS noisy FROM scores WHERE idx % 5 = 0 GROUP BY clip")
def noise_probe(spark, sf):
    return sampling.noise_probe(V.scores(spark, sf))


@query(f"WITH {V.SCORES}, g AS (SELECT clip, pts_us - lag(pts_us) OVER (PARTITION BY clip ORDER BY pts_us) AS gap FROM scores), s AS (SELECT clip, list_sort(list(gap) FILTER (gap > 0)) AS l FROM g GROUP BY clip) SELECT clip, coalesce(round(1e6 / l[len(l) // 2 + 1], 9), 30) AS fps FROM s")
def frame_rate_estimate(spark, sf):
    return sampling.frame_rate(V.scores(spark, sf))


@query("""SELECT l_linenumber AS track, epoch_us(l_shipdate) AS pts, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS place, l_quantity AS size FROM lineitem""")
def reorder_by_pts(spark, sf):
    tie = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    packets = V.table(spark, sf, "lineitem").select(c("l_linenumber").alias("track"), V.micros("l_shipdate").alias("pts"), tie.alias("tie"), c("l_quantity").alias("size"))
    return sampling.reordered(packets).select("track", "pts", "place", "size")


@query("WITH s AS (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) % 5000 AS frames FROM orders) SELECT id, o AS \"offset\", least(1024, frames - o) AS length, CAST(round(o / 44100.0::DOUBLE * 1e9) AS BIGINT) AS pts_ns FROM (SELECT *, unnest(range(0, frames, 1024)) AS o FROM s)")
def audio_chunks(spark, sf):
    streams = V.table(spark, sf, "orders").select(c("o_orderkey").alias("id"), (F.round("o_totalprice").cast("long") % 5000).alias("frames"), F.lit(44100.0).alias("rate"))
    return sampling.audio_chunks(streams, 1024)


# ---- segmentation

FRAMES = "frames AS (SELECT vec_id // 250 AS clip, vec_id AS idx, embedding FROM embeddings)"


def _frames(spark, sf):
    return V.table(spark, sf, "embeddings").select(F.floor(c("vec_id") / 250).alias("clip"), c("vec_id").alias("idx"), c("embedding").alias("signature"))


_LAGGED = f"WITH {FRAMES}, p AS (SELECT clip, idx, embedding AS e, lag(embedding) OVER (PARTITION BY clip ORDER BY idx) AS b FROM frames), d AS (SELECT clip, idx, list_sum(list_transform(list_zip(e, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) AS l1, len(e) AS n FROM p WHERE b IS NOT NULL) "


@query(_LAGGED + "SELECT clip, idx, round(l1, 6) AS l1 FROM d")
def lag_delta_l1(spark, sf):
    return segment.lagged(_frames(spark, sf)).select("clip", "idx", F.round(segment.l1(c("signature"), c("before")), 6).alias("l1"))


@query(_LAGGED + "SELECT clip, idx, round(l1 / n, 6) AS delta FROM d")
def mean_abs_delta(spark, sf):
    return segment.lagged(_frames(spark, sf)).select("clip", "idx", F.round(segment.mean_abs(c("signature"), c("before")), 6).alias("delta"))


def _threshold(l: str, k: float, scale: str) -> str:
    """SQL for the adaptive threshold of the sorted list l."""
    median = f"{l}[len({l}) // 2 + 1]"
    if scale == "mad":
        return f"{median} + {k} * greatest(list_sort(list_transform({l}, lambda q: abs(q - {median})))[len({l}) // 2 + 1], 0.01::DOUBLE)"
    p90 = f"{l}[CAST(round(0.9::DOUBLE * (len({l}) - 1)) AS BIGINT) + 1]"
    return f"{p90} + {k} * greatest({p90} - {median}, 0.01::DOUBLE)"


def _two_pass(scale: str) -> str:
    return f"""WITH {V.SCORES}, s AS (SELECT clip, list_sort(list(score)) AS l FROM scores GROUP BY clip), t AS (SELECT clip, {_threshold("l", 2.0, scale)} AS threshold FROM s WHERE len(l) > 2),
n AS (SELECT *, lag(score, 1, 0) OVER w AS a, lead(score, 1, 0) OVER w AS b FROM scores WINDOW w AS (PARTITION BY clip ORDER BY idx))
SELECT clip, idx, round(threshold, 6) AS threshold FROM n JOIN t USING (clip) WHERE score > threshold AND score >= a AND score >= b"""


@query(_two_pass("tail"))
def two_pass_cuts_tail(spark, sf):
    return segment.two_pass_cuts(V.scores(spark, sf), scale="tail")


@query(_two_pass("mad"))
def two_pass_cuts_mad(spark, sf):
    return segment.two_pass_cuts(V.scores(spark, sf), scale="mad")


def _causal(scale: str, k: float) -> str:
    t = _threshold("l", k, scale)
    return f"""WITH RECURSIVE {V.SCORES}, r AS (
  SELECT clip, 0::BIGINT AS idx, score, [score] AS w, list_sort([score]) AS l, 1073741825::BIGINT AS since, false AS cut FROM scores WHERE idx = 0
  UNION ALL
  SELECT clip, idx, score, w, list_sort(w) AS l, since, cut FROM (
    SELECT clip, idx, score, CASE WHEN cut THEN w0 ELSE list_slice(list_append(w0, CASE WHEN warm THEN score ELSE least(score, t) END), greatest(1, len(w0) + 1 - 47), len(w0) + 1) END AS w, CASE WHEN cut THEN 0 ELSE since0 + 1 END AS since, cut FROM (
      SELECT *, NOT warm AND score > t AND since0 >= 6 AS cut FROM (
        SELECT s.clip, s.idx, s.score, r.w AS w0, r.since AS since0, len(r.w) < 12 AS warm, {t} AS t FROM r JOIN scores s ON s.clip = r.clip AND s.idx = r.idx + 1)))
) SELECT clip, idx FROM r WHERE cut"""


@query(_causal("tail", 1.0))
def causal_cuts_tail(spark, sf):
    return segment.causal_cuts(V.scores(spark, sf), k=1.0, scale="tail").select("clip", c("idx").cast("long").alias("idx"))


@query(_causal("mad", 2.0))
def causal_cuts_mad(spark, sf):
    return segment.causal_cuts(V.scores(spark, sf), k=2.0, scale="mad").select("clip", c("idx").cast("long").alias("idx"))


@query(f"""WITH RECURSIVE {V.SCORES}, r AS (
  SELECT clip, 0::BIGINT AS idx, 0::BIGINT AS last, true AS cut FROM scores WHERE idx = 0
  UNION ALL
  SELECT s.clip, s.idx, CASE WHEN s.score > 100 AND s.idx - r.last >= 6 THEN s.idx ELSE r.last END, s.score > 100 AND s.idx - r.last >= 6 FROM r JOIN scores s ON s.clip = r.clip AND s.idx = r.idx + 1
) SELECT clip, idx AS start FROM r WHERE cut""")
def shot_boundaries(spark, sf):
    return segment.shots(V.scores(spark, sf), 100.0, 6).select("clip", c("start").cast("long").alias("start"))


@query(f"""WITH RECURSIVE {V.SCORES}, r AS (
  SELECT clip, 0::BIGINT AS idx, score AS v FROM scores WHERE idx = 0
  UNION ALL
  SELECT s.clip, s.idx, greatest(0::DOUBLE, 1 - abs(s.score - r.v) * (1 / 60.0::DOUBLE)) * 0.6::DOUBLE * r.v + (1 - greatest(0::DOUBLE, 1 - abs(s.score - r.v) * (1 / 60.0::DOUBLE)) * 0.6::DOUBLE) * s.score FROM r JOIN scores s ON s.clip = r.clip AND s.idx = r.idx + 1
) SELECT clip, idx, round(v, 6) AS v FROM r""")
def confidence_blend_scalar(spark, sf):
    return segment.blended(V.scores(spark, sf), 0.6, 60.0).select("clip", c("idx").cast("long").alias("idx"), "v")


@query(f"WITH {V.SCORES}, d AS (SELECT clip, abs(score - lag(score) OVER (PARTITION BY clip ORDER BY idx)) AS c FROM scores) SELECT clip, round(sum(c) / nullif(count(c), 0), 6) AS flicker, count(c) AS pairs FROM d GROUP BY clip")
def temporal_stability(spark, sf):
    return segment.stability(V.scores(spark, sf), ["clip"])


@query(f"WITH {FRAMES}, p AS (SELECT clip, embedding[1:3] AS e, lag(embedding[1:3]) OVER (PARTITION BY clip ORDER BY idx) AS b FROM frames), d AS (SELECT clip, list_sum(list_transform(list_zip(e, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / 3 AS c FROM p WHERE b IS NOT NULL) SELECT clip, round(avg(c), 6) AS flicker, count(c) AS pairs FROM d GROUP BY clip")
def channel_stability(spark, sf):
    return segment.channel_stability(_frames(spark, sf).withColumn("signature", F.slice("signature", 1, 3)), ["clip"])


@query("SELECT o_orderkey AS id, coalesce(greatest(0, 1 - (o_totalprice % 700) / nullif(floor(o_totalprice % 500), 0)), 0) AS reduction FROM orders")
def stability_reduction(spark, sf):
    return V.table(spark, sf, "orders").select(c("o_orderkey").alias("id"), segment.reduction(F.floor(c("o_totalprice") % 500).cast("double"), c("o_totalprice") % 700).alias("reduction"))


# ---- search

_SCORE = "(100 - id % 37 - (60 - id % 11) * exp(-4 * ({q}) * (1 + id % 5)))"


def _score(q: Column) -> Column:
    return 100 - c("id") % 37 - (60 - c("id") % 11) * F.exp(-4 * q * (1 + c("id") % 5))


@query(f"""WITH RECURSIVE i AS (SELECT c_custkey AS id, 55 + c_custkey % 40 AS target FROM customer), r AS (
  SELECT id, target, 0.1::DOUBLE AS lo, 1.0::DOUBLE AS hi, 1.0::DOUBLE AS best, 0 AS n FROM i
  UNION ALL
  SELECT id, target, CASE WHEN met THEN lo ELSE mid END, CASE WHEN met THEN mid ELSE hi END, CASE WHEN met THEN mid ELSE best END, n + 1 FROM (
    SELECT *, {_SCORE.format(q="mid")} >= target AS met FROM (SELECT *, (lo + hi) / 2 AS mid FROM r WHERE n < 8))
) SELECT id, target, {_SCORE.format(q="1.0::DOUBLE")} >= target AS met, CASE WHEN {_SCORE.format(q="1.0::DOUBLE")} >= target THEN best ELSE 1.0 END AS quality FROM r WHERE n = 8""")
def quality_search(spark, sf):
    items = V.table(spark, sf, "customer").select(c("c_custkey").alias("id"), (55 + c("c_custkey") % 40).alias("target"))
    return search.lowest_quality(items, _score, c("target")).select("id", "target", "met", "quality")


def _rate_score(b: Column) -> Column:
    return 98 - c("id") % 13 * 3 - (50 + c("id") % 17) * F.exp(-b / (4e5 * (1 + c("id") % 7)))


_RATE = "(98 - id % 13 * 3 - (50 + id % 17) * exp(-({b}) / (4e5::DOUBLE * (1 + id % 7))))"
_BITRATE = f"""WITH RECURSIVE i AS (SELECT c_custkey AS id, 60.0 + c_custkey % 35 AS target, 1e6::DOUBLE * (1 + c_custkey % 9) AS ceiling, c_custkey % 2 = 0 AS smaller FROM customer), r AS (
  SELECT id, target, smaller, ceiling, ceiling * CASE WHEN smaller THEN 0.35::DOUBLE ELSE 0.04::DOUBLE END AS first, ceiling * CASE WHEN smaller THEN 0.35::DOUBLE ELSE 0.04::DOUBLE END AS lo, ceiling AS hi, NULL::DOUBLE AS best, NULL::DOUBLE AS mb, NULL::DOUBLE AS mp, 0 AS passes, '' AS stop, 0 AS n FROM i
  UNION ALL
  SELECT id, target, smaller, ceiling, first,
    CASE WHEN done OR narrow OR met THEN lo ELSE b END, CASE WHEN done OR narrow OR NOT met THEN hi ELSE b END, CASE WHEN done OR narrow OR NOT met THEN best ELSE b END,
    CASE WHEN done OR narrow OR met THEN mb ELSE b END, CASE WHEN done OR narrow OR met THEN mp ELSE p END, CASE WHEN done OR narrow THEN passes ELSE passes + 1 END,
    CASE WHEN done THEN stop WHEN narrow THEN 'converged' WHEN NOT met AND best IS NULL AND mb IS NOT NULL AND p + CASE WHEN b > mb THEN greatest(0, (p - mp) / ((b - mb) / 1e6)) ELSE 0 END * ((hi - b) / 1e6) < target - 1 THEN 'abort' ELSE '' END, n + 1
  FROM (SELECT *, p >= target AS met FROM (SELECT *, {_RATE.format(b="b")} AS p FROM (SELECT *, (lo + hi) / 2 AS b, stop <> '' AS done, hi - lo <= hi * 0.05::DOUBLE AS narrow FROM r WHERE n < 6)))
), d AS (
  SELECT id, target, best IS NOT NULL AND lo = first AS descended, stop AS s1, best * 0.02::DOUBLE AS lo, best AS hi, best, passes, false AS done, 0 AS n FROM r WHERE n = 6
  UNION ALL
  SELECT id, target, descended, s1, CASE WHEN over OR met THEN lo ELSE b END, CASE WHEN over OR NOT met THEN hi ELSE b END, CASE WHEN over OR NOT met THEN best ELSE b END, CASE WHEN over THEN passes ELSE passes + 1 END, over, n + 1
  FROM (SELECT *, done OR NOT descended OR hi - lo <= hi * 0.05::DOUBLE AS over, {_RATE.format(b="b")} >= target AS met FROM (SELECT *, (lo + hi) / 2 AS b FROM d WHERE n < 6))
) SELECT id, descended, best, passes, CASE WHEN s1 = '' THEN 'exhausted' ELSE s1 END AS stop FROM d WHERE n = 6"""


def _searched(spark, sf):
    k = c("c_custkey")
    items = V.table(spark, sf, "customer").select(k.alias("id"), (60.0 + k % 35).alias("target"), (1e6 * (1 + k % 9)).alias("ceiling"), (k % 2 == 0).alias("smaller"))
    return search.bitrate(items, _rate_score, c("target"), c("ceiling"), c("smaller"))


@query(_BITRATE)
def bitrate_trajectory(spark, sf):
    return _searched(spark, sf).select("id", "descended", "best", "passes", "stop")


@query(f"SELECT stop, count(*) AS n FROM ({_BITRATE}) GROUP BY stop")
def search_abort(spark, sf):
    return _searched(spark, sf).groupBy("stop").agg(F.count("*").alias("n"))


@query(f"SELECT id, best FROM ({_BITRATE}) WHERE descended")
def descent_extension(spark, sf):
    return _searched(spark, sf).where("descended").select("id", "best")


@query(f"SELECT b.id, coalesce(best, ceiling) AS rate, best IS NOT NULL OR {_RATE.format(b='ceiling').replace('id', 'b.id')} >= target AS met FROM ({_BITRATE}) b JOIN (SELECT c_custkey AS id, 60.0 + c_custkey % 35 AS target, 1e6::DOUBLE * (1 + c_custkey % 9) AS ceiling FROM customer) i ON i.id = b.id")
def ceiling_fallback(spark, sf):
    return search.with_ceiling(_searched(spark, sf), _rate_score, c("target"), c("ceiling")).select("id", "rate", "met")


@query("SELECT o_orderkey AS id, round(least(0.92, 0.10 + 0.82 * (o_orderkey % 9 + 0.5) / greatest(o_orderkey % 12, o_orderkey % 9 + 1)), 9) AS fraction FROM orders")
def progress_fraction(spark, sf):
    k = c("o_orderkey")
    return V.table(spark, sf, "orders").select(k.alias("id"), F.round(search.progress(k % 9, F.lit(0.5), k % 12), 9).alias("fraction"))


# ---- policy


@query(f"WITH {V.PROFILES} SELECT id, id % 3 = 0 AS met, (id % 3 = 0 OR id % 5 = 0) AND (id % 2 <> 0 OR w < h) AS delivered, CASE WHEN h = 0 THEN 0 ELSE greatest(0, h - w) / h::DOUBLE END AS saved FROM profiles")
def delivery_rule(spark, sf):
    k = c("id")
    rule = policy.delivered(k % 3 == 0, k % 5 == 0, k % 2 == 0, c("w"), c("h"))
    return V.profiles(spark, sf).select("id", (k % 3 == 0).alias("met"), rule.alias("delivered"), policy.saved_fraction(c("w"), c("h").cast("double")).alias("saved"))


@query(f"""WITH {V.PROFILES} SELECT id, CASE WHEN least(w, h) <= 719 THEN w WHEN h <= w THEN x - x % 2 ELSE 718 END AS out_w, CASE WHEN least(w, h) <= 719 THEN h WHEN h <= w THEN 718 ELSE y - y % 2 END AS out_h
FROM (SELECT *, CAST(round(w * 718.0::DOUBLE / h) AS BIGINT) AS x, CAST(round(h * 718.0::DOUBLE / w) AS BIGINT) AS y FROM profiles)""")
def resolution_class(spark, sf):
    w, h = policy.resolution_class(c("w"), c("h"), 719)
    return V.profiles(spark, sf).select("id", w.alias("out_w"), h.alias("out_h"))


@query(f"""WITH {V.PROFILES}, b AS (SELECT *, CASE WHEN bps > 0 AND fps > 0 THEN bps / (w * h * fps) END AS bpp FROM profiles)
SELECT id, round(bpp, 9) AS bpp, bpp IS NULL AS unknown, CASE WHEN w * h < 450000 THEN CASE WHEN bpp < 0.09 THEN 'mixed' ELSE 'resolutionLimited' END WHEN bpp < 0.09 THEN 'bitrateStarved' ELSE 'clean' END AS class FROM b""")
def enhance_classify(spark, sf):
    bpp = policy.bits_per_pixel(c("w"), c("h"), c("fps"), c("bps"))
    return V.profiles(spark, sf).select("id", F.round(bpp, 9).alias("bpp"), bpp.isNull().alias("unknown"), policy.enhance_class(c("w"), c("h"), bpp).alias("class"))


@query(f"""WITH {V.CODECS_SQL} SELECT id, codec, CASE WHEN codec IN ('V_MPEG4/ISO/AVC','V_MPEGH/ISO/HEVC','V_AV1','V_MPEG2','V_MPEG1') THEN 'nativeVideo'
WHEN codec LIKE 'A\\_AAC%' ESCAPE '\\' OR codec IN ('A_OPUS','A_FLAC','A_ALAC','A_AC3','A_EAC3','A_MPEG/L1','A_MPEG/L2','A_MPEG/L3','A_PCM/INT/LIT','A_PCM/INT/BIG','A_PCM/FLOAT/IEEE') THEN 'nativeAudio' ELSE 'deferred' END AS status FROM codecs""")
def codec_gate(spark, sf):
    return V.codecs(spark, sf).select("id", "codec", policy.codec_gate(c("codec")).alias("status"))


@query(f"""WITH {V.CODECS_SQL} SELECT id, CASE trim(codec) WHEN 'avc1' THEN 'V_MPEG4/ISO/AVC' WHEN 'hev1' THEN 'V_MPEGH/ISO/HEVC' WHEN 'aac' THEN 'A_AAC' WHEN 'Opus' THEN 'A_OPUS' ELSE trim(codec) END AS unified FROM codecs""")
def codec_unify(spark, sf):
    return V.codecs(spark, sf).select("id", policy.unified(c("codec")).alias("unified"))


@query(f"""WITH {V.CODECS_SQL} SELECT id, starts_with(codec, 'A_AAC') OR codec IN ('A_OPUS','A_AC3','A_EAC3','A_MPEG/L1','A_MPEG/L2','A_MPEG/L3') AS decodable, starts_with(codec, 'A_AAC') OR codec IN ('A_OPUS','A_FLAC') AS needs_private,
CASE WHEN starts_with(codec, 'A_AAC') THEN 1024 ELSE CASE codec WHEN 'A_FLAC' THEN 4096 WHEN 'A_OPUS' THEN 960 WHEN 'A_AC3' THEN 1536 WHEN 'A_EAC3' THEN 1536 WHEN 'A_MPEG/L3' THEN 1152 WHEN 'A_MPEG/L2' THEN 1152 WHEN 'A_MPEG/L1' THEN 384 END END AS frames, CASE WHEN codec = 'A_OPUS' THEN 48000 ELSE rate END AS rate FROM codecs""")
def audio_decodable(spark, sf):
    x = c("codec")
    return V.codecs(spark, sf).select("id", policy.audio_decodable(x).alias("decodable"), policy.needs_private(x).alias("needs_private"), policy.packet_frames(x).alias("frames"), policy.decode_rate(x, c("rate")).alias("rate"))


@query(f"""WITH {V.CODECS_SQL}, f AS (SELECT * FROM codecs WHERE (starts_with(codec, 'A_AAC') OR codec IN ('A_OPUS','A_AC3','A_EAC3','A_MPEG/L1','A_MPEG/L2','A_MPEG/L3')) AND channels > 0 AND rate > 0 AND (NOT (starts_with(codec, 'A_AAC') OR codec IN ('A_OPUS','A_FLAC')) OR has_private))
SELECT id % 3 AS file, arg_min(codec, id) AS codec, min(id) AS track FROM f GROUP BY 1""")
def audio_track(spark, sf):
    return policy.audio_track(V.codecs(spark, sf).withColumn("file", c("id") % 3), ["file"])


@query(f"""WITH {V.CODECS_SQL} SELECT id, CASE WHEN NOT starts_with(codec, 'A_AAC') OR rate > 112000 * channels THEN least(96000 * channels, 384000) END AS bitrate FROM codecs""")
def audio_rung(spark, sf):
    return V.codecs(spark, sf).select("id", policy.audio_rung(c("codec"), c("rate"), c("channels")).alias("bitrate"))


@query(f"""WITH {V.CODECS_SQL} SELECT id, CASE WHEN e IN ('mp4', 'MOV') THEN CASE WHEN codec = 'V_MPEGH/ISO/HEVC' THEN 'passthrough' ELSE 'transcode' END ELSE 'demux' END AS route FROM (SELECT *, ['mp4','MOV','mkv'][id % 3 + 1] AS e FROM codecs)""")
def normalize_route(spark, sf):
    e = F.element_at(F.array(F.lit("mp4"), F.lit("MOV"), F.lit("mkv")), (c("id") % 3 + 1).cast("int"))
    return V.codecs(spark, sf).select("id", policy.normalize_route(e, c("codec")).alias("route"))


def _delays(spark, sf):
    v = c("value")
    return V.table(spark, sf, "events").select(c("event_id").alias("id"), F.when(c("event_id") % 3 == 0, v / 10000).alias("a"), F.when(c("event_id") % 5 != 0, v / 1000000).alias("b"))


_DELAYS = "WITH d AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN value / 10000 END AS a, CASE WHEN event_id % 5 <> 0 THEN value / 1000000 END AS b FROM events) "


@query(_DELAYS + "SELECT id, CASE WHEN coalesce(a, b, 0.1) <= 0.010 THEN 0.1 ELSE coalesce(a, b, 0.1) END AS delay FROM d")
def gif_delays(spark, sf):
    return _delays(spark, sf).select("id", policy.gif_delay(c("a"), c("b")).alias("delay"))


@query(_DELAYS + "SELECT id, CASE WHEN coalesce(a, b, 0) > 0.0001 THEN coalesce(a, b, 0) ELSE 0.1 END AS delay FROM d")
def still_delays(spark, sf):
    return _delays(spark, sf).select("id", policy.still_delay(c("a"), c("b")).alias("delay"))


@query(f"WITH {V.SCORES} SELECT clip, idx, round(coalesce(sum(score) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS pts FROM scores")
def delay_pts(spark, sf):
    before = sampling.Window.partitionBy("clip").orderBy("idx").rowsBetween(sampling.Window.unboundedPreceding, -1)
    return V.scores(spark, sf).select("clip", "idx", F.round(F.coalesce(F.sum("score").over(before), F.lit(0.0)), 6).alias("pts"))


@query(f"WITH {V.PROFILES} SELECT id, w - w % 2 AS w, h - h % 2 AS h, round(least(greatest(w * h * fps * 0.3, 8e6), 60e6), 3) AS bps FROM profiles")
def gif_mezzanine(spark, sf):
    w, h, bps = policy.mezzanine(c("w"), c("h"), c("fps"))
    return V.profiles(spark, sf).select("id", w.alias("w"), h.alias("h"), F.round(bps, 3).alias("bps"))


@query(f"WITH {V.PROFILES} SELECT id, CASE WHEN id % 4 % 2 <> 0 THEN b ELSE a END AS w, CASE WHEN id % 4 % 2 <> 0 THEN a ELSE b END AS h FROM (SELECT id, greatest(1, CAST(round(w * 150 / 72.0::DOUBLE) AS BIGINT)) AS a, greatest(1, CAST(round(h * 150 / 72.0::DOUBLE) AS BIGINT)) AS b FROM profiles)")
def pdf_dimensions(spark, sf):
    w, h = policy.pdf_size(c("w"), c("h"), c("id") % 4 * 90, 150)
    return V.profiles(spark, sf).select("id", w.alias("w"), h.alias("h"))


@query(f"WITH {V.PROFILES} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN 'P3' END, CASE WHEN h < 720 AND w < 1280 THEN '601' ELSE '709' END) AS colour FROM profiles")
def colour_default(spark, sf):
    return V.profiles(spark, sf).select("id", policy.colour_default(c("w"), c("h"), F.when(c("id") % 3 == 0, "P3")).alias("colour"))


@query("SELECT n_nationkey AS id, coalesce(['HLG','PQ','SDR',NULL][n_nationkey % 4 + 1] IN ('HLG','PQ'), false) AS hdr FROM nation")
def hdr_predicate(spark, sf):
    tag = F.element_at(F.array(F.lit("HLG"), F.lit("PQ"), F.lit("SDR"), F.lit(None)), (c("n_nationkey") % 4 + 1).cast("int"))
    return V.table(spark, sf, "nation").select(c("n_nationkey").alias("id"), policy.is_hdr(tag).alias("hdr"))


@query("SELECT c_mktsegment AS codec, arg_max(c_name, c_custkey) AS impl FROM customer GROUP BY 1")
def registry_last_wins(spark, sf):
    return policy.last_registered(V.table(spark, sf, "customer").select(c("c_mktsegment").alias("codec"), c("c_name").alias("impl"), c("c_custkey").alias("seq")), ["codec"])


@query("SELECT p_brand AS frame, arg_min(p_partkey, (p_retailprice, p_partkey)) AS variant, min(p_retailprice) AS bytes FROM part WHERE p_size > 10 GROUP BY 1")
def smallest_variant(spark, sf):
    p = V.table(spark, sf, "part").select(c("p_brand").alias("frame"), c("p_partkey").alias("variant"), c("p_retailprice").alias("bytes"), (c("p_size") > 10).alias("met"))
    return policy.smallest_variant(p, ["frame"])


_OUTCOMES = "['passed','failed','skipped']"


@query(f"""WITH c AS (SELECT c_custkey AS id, ['passed', {_OUTCOMES}[c_custkey % 3 + 1], {_OUTCOMES}[c_custkey // 3 % 3 + 1]] AS o FROM customer)
SELECT id, CASE WHEN list_contains(o, 'failed') THEN 'corrupt' WHEN o[2] <> 'skipped' OR o[3] <> 'skipped' THEN 'intact' ELSE 'unverified' END AS verdict, CASE WHEN o[2] = 'failed' THEN 'boxes of ' || id WHEN o[3] = 'failed' THEN 'crc of ' || id END AS failure FROM c""")
def verdict_lattice(spark, sf):
    k, names = c("c_custkey"), F.array(*map(F.lit, ("passed", "failed", "skipped")))
    check = lambda name, o: F.struct(F.lit(name).alias("name"), o.alias("outcome"), F.concat(F.lit(f"{name} of "), k).alias("detail"))
    checks = F.array(check("readable", F.lit("passed")), check("boxes", F.element_at(names, (k % 3 + 1).cast("int"))), check("crc", F.element_at(names, (F.floor(k / 3) % 3 + 1).cast("int"))))
    return V.table(spark, sf, "customer").select(k.alias("id"), policy.verdict(checks).alias("verdict"), policy.first_failure(checks).alias("failure"))


@query("""WITH p AS (SELECT l_orderkey AS k, CAST(round(l_quantity * 5) AS INTEGER) AS c, CAST(round(l_discount * 2550) AS INTEGER) % 256 AS a FROM lineitem), m AS (SELECT DISTINCT c, a, least(255, CAST(round(c * a / 255.0::DOUBLE) AS INTEGER)) AS pre FROM p)
SELECT c, a, pre, CASE WHEN a = 0 THEN 0 ELSE least(255, CAST(round(pre * 255.0::DOUBLE / a) AS INTEGER)) END AS post FROM m""")
def premultiply_roundtrip(spark, sf):
    p = V.table(spark, sf, "lineitem").select(F.round(c("l_quantity") * 5).cast("int").alias("c"), (F.round(c("l_discount") * 2550).cast("int") % 256).alias("a")).distinct()
    p = p.withColumn("pre", policy.premultiplied(c("c"), c("a")))
    return p.withColumn("post", policy.unpremultiplied(c("pre"), c("a")))


@query("""WITH b AS (SELECT vec_id AS id, list_transform(embedding[1:4], lambda v: 1 - abs(v::DOUBLE)) AS bands, 1 - abs(embedding[5]::DOUBLE) AS base FROM embeddings)
SELECT id, CASE WHEN greatest(1 - bands[1], 1 - bands[3], 1 - bands[4], 1 - base) < 1e-3 THEN true ELSE greatest(1 - bands[3], 1 - bands[4], 1 - base) <= (1 - bands[1]) * 0.5 END AS expected FROM b""")
def expected_signature(spark, sf):
    bands = F.transform(F.slice("embedding", 1, 4), lambda v: 1 - F.abs(v.cast("double")))
    return V.table(spark, sf, "embeddings").select(c("vec_id").alias("id"), policy.expected_signature(bands, 1 - F.abs(F.get("embedding", 4).cast("double"))).alias("expected"))


@query("SELECT n_nationkey AS id, greatest(4, n_nationkey - 8) AS \"window\", greatest(2, n_nationkey - 10) AS history, greatest(1, n_nationkey - 12) AS gap, least(greatest(n_nationkey / 10.0::DOUBLE - 0.5, 0), 1) AS quality, least(n_nationkey, 6) AS level FROM nation")
def option_clamps(spark, sf):
    k = c("n_nationkey")
    rows = V.table(spark, sf, "nation").select(k.alias("id"), policy.clamped_detector(k - 8, k - 10, k - 12).alias("d"), policy.clamped_encoder(k / 10.0 - 0.5, k).alias("e"))
    return rows.select("id", "d.*", "e.*")


# Every extension that is known, and some that aren't.
_STILLS = "PNG jpg JPEG tif tiff heic heif avif bmp gif Cr2 cr3 nef arw raf orf rw2 dng pef 3fr iiq gpr pdf webp srw raw xyz".split()


@query("""SELECT id, CASE WHEN k = 0 THEN 'png' WHEN k <= 2 THEN 'jpeg' WHEN k <= 4 THEN 'tiff' WHEN k <= 6 THEN 'heic' WHEN k = 7 THEN 'avif' WHEN k = 8 THEN 'bmp' WHEN k = 9 THEN 'gif' WHEN k <= 21 THEN 'raw' ELSE 'unknown' END AS format,
CASE WHEN k = 22 THEN 'pdf' WHEN k BETWEEN 10 AND 21 THEN 'raw' ELSE 'image' END AS route FROM (SELECT page_id AS id, page_id % 27 AS k FROM pages)""")
def still_formats(spark, sf):
    path = F.concat(F.lit("/a.b/c."), F.element_at(F.array(*map(F.lit, _STILLS)), (c("page_id") % len(_STILLS) + 1).cast("int")))
    return V.table(spark, sf, "pages").select(c("page_id").alias("id"), policy.still_format(path).alias("format"), policy.still_route(path).alias("route"))


@query("""SELECT n_nationkey AS id, n_nationkey % 5 AS width, n_nationkey % 7 AS height, CASE WHEN n_nationkey % 3 = 0 THEN 8 ELSE n_nationkey % 3 * 8 END AS depth,
CASE WHEN n_nationkey % 2 = 1 THEN 'none' WHEN n_nationkey % 4 = 0 THEN 'premultiplied' ELSE 'straight' END AS alpha, CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE n_nationkey % 6 END AS orientation, CASE WHEN n_nationkey % 3 = 0 THEN 96 ELSE 72 + n_nationkey END::DOUBLE AS dpi FROM nation""")
def still_metadata(spark, sf):
    k, some = c("n_nationkey"), lambda v: F.nullif(v, F.lit(0))
    found = policy.still_metadata(some(k % 5), some(k % 7), some(k % 3 * 8), k % 2 == 0, k % 4 == 0, some(k % 6), F.when(k % 3 != 0, (72 + k).cast("double")), F.lit(96.0))
    return V.table(spark, sf, "nation").select(k.alias("id"), found.alias("m")).select("id", "m.*")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'mov' ELSE 'mp4' END AS container, CAST(round(abs(o_totalprice / 100 * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END)) AS BIGINT) AS width,
CAST(round(abs(o_custkey * 0.25 * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END)) AS BIGINT) AS height, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 4 * 12.5 END::DOUBLE AS fps, true AS decodable FROM orders""")
def native_probe(spark, sf):
    """Sizes of either sign, as a turned track has them, and tracks without a rate."""
    k, o = c("o_orderkey"), V.table(spark, sf, "orders")
    found = policy.native_probe(F.when(c("o_orderpriority").startswith("1"), "MOV").otherwise("m4v"), c("o_totalprice") / 100 * F.when(k % 3 == 0, -1).otherwise(1), c("o_custkey") * 0.25 * F.when(k % 5 == 0, -1).otherwise(1), F.when(k % 4 != 0, (k % 4) * 12.5))
    return o.select(k.alias("id"), found.alias("p")).select("id", "p.*")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1e9 / (n_nationkey % 3 * 20000000) END AS fps, greatest(0, n_nationkey * 40 - 100) AS pts, n_nationkey * CAST(round(600 / 25.0::DOUBLE) AS BIGINT) AS step, format('shot-{:03d}.png', n_nationkey + 1) AS file, n_nationkey % 2 = 0 OR n_nationkey % 5 = 0 AS writable, n_nationkey % 2 = 0 AND n_nationkey % 3 <> 1 AS refused FROM nation")
def container_rules(spark, sf):
    k = c("n_nationkey")
    ext = F.when(k % 2 == 0, "MOV").otherwise("webm")
    return V.table(spark, sf, "nation").select(
        k.alias("id"), policy.probe_fps(F.when(k % 3 == 0, 0).otherwise(k % 3 * 20000000)).alias("fps"), policy.rebased(k * 40, F.lit(100)).alias("pts"), policy.step_pts(k, F.lit(25.0)).alias("step"),
        policy.sequence_name(F.lit("shot"), k, F.lit(25), "png").alias("file"), policy.transparent(ext, k % 5 == 0).alias("writable"), policy.alpha_refused(F.when(k % 2 == 0, True), F.when(k % 3 == 1, True)).alias("refused"),
    )


# ---- planes

_WITH = f"WITH {V.PLANES}"


@query(_WITH + ", o AS (SELECT id, y // 2 AS y, x // 2 AS x, v FROM planes) SELECT id, y, x, round(sum(v) / 4, 6) AS v FROM o GROUP BY id, y, x")
def downscale2(spark, sf):
    return P.downscaled(V.planes(spark, sf), 8, 8).withColumn("v", F.round("v", 6))


@query(_WITH + """, t AS (SELECT i, o, least(i + 1, (o + 1) * 8 / 3.0::DOUBLE) - greatest(i, o * 8 / 3.0::DOUBLE) AS w FROM range(8) a(i), range(3) b(o)),
x AS (SELECT id, y, o AS x, sum(v * w) / sum(w) AS v FROM planes JOIN t ON t.i = planes.x AND w > 0 GROUP BY id, y, o)
SELECT id, o AS y, x, round(sum(v * w) / sum(w), 4) AS v FROM x JOIN t ON t.i = x.y AND w > 0 GROUP BY id, o, x""")
def area_resample(spark, sf):
    return P.area_resampled(V.planes(spark, sf), 8, 8, 3, 3).withColumn("v", F.round("v", 4))


@query(_WITH + """, f AS (SELECT o, greatest(0, (o + 0.5::DOUBLE) * 8 / 12 - 0.5) AS f FROM range(12) b(o)), t AS (SELECT o, least(7, floor(f)::INT) AS i, 1 - (f - floor(f)) AS w FROM f UNION ALL SELECT o, least(7, floor(f)::INT + 1), f - floor(f) FROM f),
x AS (SELECT id, y, o AS x, sum(v * w) AS v FROM planes JOIN t ON t.i = planes.x GROUP BY id, y, o)
SELECT id, o AS y, x, round(sum(v * w), 6) AS v FROM x JOIN t ON t.i = x.y GROUP BY id, o, x""")
def bilinear_expand(spark, sf):
    return P.expanded(V.planes(spark, sf), 8, 8, 12, 12).withColumn("v", F.round("v", 6))


@query(_WITH + """, k AS (SELECT k, exp(-(k * k) / 4.5::DOUBLE) / (SELECT sum(exp(-(k * k) / 4.5::DOUBLE)) FROM range(-6, 7) a(k)) AS w FROM range(-6, 7) a(k)), t AS (SELECT o, least(greatest(o + k, 0), 7) AS i, w FROM range(8) b(o), k),
x AS (SELECT id, y, o AS x, sum(v * w) AS v FROM planes JOIN t ON t.i = planes.x GROUP BY id, y, o)
SELECT id, o AS y, x, round(sum(v * w), 6) AS v FROM x JOIN t ON t.i = x.y GROUP BY id, o, x""")
def gaussian_blur(spark, sf):
    return P.blurred(V.planes(spark, sf), 8, 8).withColumn("v", F.round("v", 6))


@query(_WITH + ", d AS (SELECT id, avg((v - CASE WHEN id % 7 = 0 THEN v ELSE round(v, 1) END) * (v - CASE WHEN id % 7 = 0 THEN v ELSE round(v, 1) END)) AS mse FROM planes GROUP BY id) SELECT id, CASE WHEN mse = 0 THEN 'inf' ELSE CAST(round(10 * log10(1 / mse), 2)::DECIMAL(10, 2) AS VARCHAR) END AS psnr FROM d")
def psnr(spark, sf):
    d = c("v") - F.when(c("id") % 7 == 0, c("v")).otherwise(F.round("v", 1))
    rows = V.planes(spark, sf).groupBy("id").agg(F.avg(d * d).alias("mse")).select("id", P.psnr(c("mse")).alias("p"))
    return rows.select("id", F.when(c("p") == float("inf"), "inf").otherwise(F.round("p", 2).cast("decimal(10,2)").cast("string")).alias("psnr"))


PLANE64 = """plane64 AS (SELECT (k - 1) // 4096 AS id, (k - 1) % 4096 // 64 AS y, (k - 1) % 64 AS x, q / 50 AS v, floor(q / 5) / 10 AS d FROM (SELECT l_quantity AS q, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem))"""


def _samples64(spark, sf):
    """k, q: all rows by the six-column key, from 0."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return sampling.numbered(V.table(spark, sf, "lineitem").select(*key), [], key, "k", ["l_quantity"]).select("k", c("l_quantity").alias("q"))


def _planes64(samples):
    """Samples (k, q) as 64 x 64 planes."""
    k, q = c("k"), c("q")
    return samples.select(F.floor(k / 4096).alias("id"), F.floor(k % 4096 / 64).cast("int").alias("y"), (k % 64).cast("int").alias("x"), (q / 50).alias("v"), (F.floor(q / 5) / 10).alias("d"))


def _plane64(spark, sf):
    """All rows by the six-column key as 64 x 64 planes, 4,096 rows each; the last plane may be partial."""
    return _planes64(_samples64(spark, sf))


@query(f"WITH {PLANE64} SELECT id, y // 10 AS tile_y, x // 10 AS tile_x, round(avg(v), 6) AS mean, count(*) AS n FROM plane64 GROUP BY ALL")
def tile_stats(spark, sf):
    return P.tiles(_plane64(spark, sf), 10)


@query(f"WITH {PLANE64}, t AS (SELECT id, y // 10 AS a, x // 10 AS b, round(avg(v), 6) AS mean FROM plane64 GROUP BY ALL) SELECT id, min(mean) AS worst, round(avg(mean), 6) AS mean FROM t GROUP BY id")
def tile_worst(spark, sf):
    return P.tiles(_plane64(spark, sf), 10).groupBy("id").agg(F.min("mean").alias("worst"), F.round(F.avg("mean"), 6).alias("mean"))


@query(_WITH + " SELECT id, round(avg(abs(v)), 6) AS l1, round(sqrt(sqrt(avg(v * v * v * v))), 6) AS l4 FROM planes GROUP BY id")
def l1_l4_pool(spark, sf):
    return P.pooled(V.planes(spark, sf))


@query(_WITH + ", o AS (SELECT y AS oy, x AS ox FROM range(5) a(y), range(5) b(x)) SELECT id, oy AS y, ox AS x, round(v, 6) AS v FROM o JOIN planes ON planes.y = oy * 8 // 5 AND planes.x = ox * 8 // 5")
def nearest_resize(spark, sf):
    return P.nearest_resized(V.planes(spark, sf), 8, 8, 5, 5).withColumn("v", F.round("v", 6))


@query(_WITH + ", o AS (SELECT y AS oy, x AS ox FROM range(3) a(y), range(5) b(x)) SELECT id, oy AS y, ox AS x, round(v, 6) AS v FROM o JOIN planes ON planes.y = oy * 8 // 3 + 8 // 6 AND planes.x = ox * 8 // 5 + 8 // 10")
def cell_centres(spark, sf):
    return P.point_sampled(V.planes(spark, sf), 8, 8, 5, 3).withColumn("v", F.round("v", 6))


@query("""WITH c AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) * 5 AS q FROM lineitem), l AS (SELECT q, CASE WHEN q / 255.0::DOUBLE <= 0.04045 THEN q / 255.0::DOUBLE / 12.92 ELSE pow((q / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS v FROM c),
m AS (SELECT q, v, cbrt(0.30 * v + 0.622 * (1 - v) + 0.078 * 0.5 + 0.0037930732552754493) - cbrt(0.0037930732552754493::DOUBLE) AS l, cbrt(0.23 * v + 0.692 * (1 - v) + 0.078 * 0.5 + 0.0037930732552754493) - cbrt(0.0037930732552754493::DOUBLE) AS m, cbrt(0.24342268924547819::DOUBLE * v + 0.20476744424496821::DOUBLE * (1 - v) + 0.5518098657995536::DOUBLE * 0.5 + 0.0037930732552754493) - cbrt(0.0037930732552754493::DOUBLE) AS s FROM l)
SELECT q, round(v, 6) AS linear, round((l - m) / 2 * 14 + 0.42, 6) AS x, round((l + m) / 2 + 0.01, 6) AS y, round(s - (l + m) / 2 + 0.55, 6) AS b, round(0.299 * q + 0.587 * (255 - q) + 0.114 * 128, 6) AS y601, round((0.2126 * q + 0.7152 * (255 - q) + 0.0722 * 128) / 255, 6) AS y709 FROM m""")
def colour_math(spark, sf):
    q = V.table(spark, sf, "lineitem").select((F.round("l_quantity").cast("int") * 5).alias("q")).distinct()
    rows = q.withColumn("v", P.to_linear(c("q") / 255.0))
    x, y, b = P.positive_xyb(c("v"), 1 - c("v"), F.lit(0.5))
    luma = [f(c("q"), 255 - c("q"), F.lit(128)) for f in (P.luma601, P.luma709)]
    return rows.select("q", *[F.round(e, 6).alias(n) for e, n in ((c("v"), "linear"), (x, "x"), (y, "y"), (b, "b"), (luma[0], "y601"), (luma[1], "y709"))])


@query(_WITH + """, f AS (SELECT id, y AS oy, x AS ox, x + 0.25::DOUBLE AS fx, y + 0.5::DOUBLE AS fy FROM planes), t AS (SELECT *, fx <= 7 AND fy <= 7 AS ok, least(7, floor(fx)::INT) AS x0, least(7, floor(fx)::INT + 1) AS x1, least(7, floor(fy)::INT) AS y0, least(7, floor(fy)::INT + 1) AS y1 FROM f)
SELECT t.id, oy AS y, ox AS x, CASE WHEN ok THEN round((a.v * 0.75 + b.v * 0.25) * 0.5 + (c.v * 0.75 + d.v * 0.25) * 0.5, 6) END AS v FROM t
JOIN planes a ON a.id = t.id AND a.y = y0 AND a.x = x0 JOIN planes b ON b.id = t.id AND b.y = y0 AND b.x = x1 JOIN planes c ON c.id = t.id AND c.y = y1 AND c.x = x0 JOIN planes d ON d.id = t.id AND d.y = y1 AND d.x = x1""")
def backward_warp(spark, sf):
    p = V.planes(spark, sf)
    flow = p.select("id", "y", "x", F.lit(0.25).alias("u"), F.lit(0.5).alias("w"))
    return P.warped(p, flow, 8, 8).withColumn("v", F.round("v", 6))


# ---- dense kernels, rows only


def _dense(spark, sf):
    flat = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("y", "x", name))), lambda s: s[name])
    rows = _plane64(spark, sf).groupBy("id").agg(flat("v").alias("a"), flat("d").alias("b"))
    return rows


def _kernel(f):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        # Samples that a partial plane lacks are 0.
        side = lambda x: np.resize(np.append(np.array(x.as_py(), np.float32), np.zeros(4096 - len(x), np.float32)), (64, 64))
        return pa.array([float(f(side(x), side(y))) for x, y in zip(a, b)], pa.float64())

    return run


@query()
def ssimulacra2(spark, sf):
    image = lambda p: np.repeat(np.rint(np.clip(p, 0, 1) * 255).astype(np.uint8)[..., None], 3, axis=2)
    return _dense(spark, sf).select("id", F.round(_kernel(lambda a, b: kernels.ssimulacra2(image(a), image(b)))("a", "b"), 4).alias("score"))


@query()
def crc32_blocks(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", F.crc32(F.concat(F.lit(b"IDAT"), F.coalesce("text", F.lit("")).cast("binary"))).alias("crc"))


# The queries of these modules are registered when they are imported.
from . import container_queries, dense_queries, recording_queries, sequence_queries  # noqa: E402, F401

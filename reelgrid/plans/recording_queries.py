"""Queries over tiles, recorded spans, repeated runs, exports and plans of sampling and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import census, planes, policy, recording, sampling, search, tiles
from ..operators import spans as S
from . import views as V
from .catalogue import _BITRATE, _RATE, MERGED, PLANE64, _plane64, _rate_score, _searched
from .registry import query

c = F.col

# ---- tiles


@query("""WITH i AS (SELECT p_partkey AS id, 320 + (p_partkey * 37 % 40) * 80 AS w, 240 + (p_partkey * 53 % 30) * 60 AS h FROM part),
s AS (SELECT *, w * h <= 1000000 AS alone, greatest(w - 512, 0) AS lx, greatest(h - 512, 0) AS ly FROM i),
t AS (SELECT *, unnest(range(0, CASE WHEN alone THEN 1 ELSE CAST(ceil(ly / 480) AS BIGINT) + 1 END)) AS j FROM s), u AS (SELECT *, CASE WHEN alone THEN 1 ELSE CAST(ceil(lx / 480) AS BIGINT) + 1 END AS across FROM t),
x AS (SELECT *, unnest(range(0, across)) AS i FROM u)
SELECT id, j * across + i AS n, least(i * 480, lx) * (NOT alone)::INT AS x0, least(j * 480, ly) * (NOT alone)::INT AS y0, CASE WHEN alone THEN w ELSE least(w, 512) END AS tw, CASE WHEN alone THEN h ELSE least(h, 512) END AS th FROM x""")
def tile_grid(spark, sf):
    """Tiles of every source by its size; those of up to a million pixels are one tile."""
    return tiles.grid(V.profiles(spark, sf).select("id", "w", "h"), whole=1_000_000).select("id", "n", "x0", "y0", "tw", "th")


_TILED = f"""WITH {PLANE64}, s AS (SELECT unnest(range(0, 4)) AS k), g AS (SELECT least(k * 16, 40) AS s, k FROM s),
t AS (SELECT id, j.k * 4 + i.k AS n, y - j.s AS r, x - i.s AS c, j.s AS y0, i.s AS x0, 255 - round(v * 250) AS v FROM plane64 JOIN g i ON x BETWEEN i.s AND i.s + 23 JOIN g j ON y BETWEEN j.s AND j.s + 23),
p AS (SELECT *, round((coalesce(lag(v) OVER o, v) + v + coalesce(lead(v) OVER o, v)) / 3.0::DOUBLE) AS q FROM t WINDOW o AS (PARTITION BY id, n, r ORDER BY c)),
w AS (SELECT *, least(c / 8.0::DOUBLE, (23 - c) / 8.0::DOUBLE, 1) * least(r / 8.0::DOUBLE, (23 - r) / 8.0::DOUBLE, 1) AS w FROM p),
l AS (SELECT id, y0 + r AS y, x0 + c AS x, list({{'v': q::DOUBLE, 'w': w::DOUBLE}} ORDER BY n) AS of FROM w GROUP BY ALL)
SELECT id, y, x, list_reduce(of, lambda s, e: {{'v': CASE WHEN e.w >= 0.999 THEN e.v ELSE round(greatest(0, least(255, s.v * (1 - e.w) + e.v * e.w))) END, 'w': e.w}}).v AS v FROM l"""


@query(_TILED)
def tiled_chain(spark, sf):
    """Planes of lineitem in tiles of 24 x 24 with an overlap of 8: inverted, then smoothed in each tile, then feathered."""
    pixels = _plane64(spark, sf).select("id", "y", "x", F.round(c("v") * 250).alias("v"), F.lit(64).alias("w"), F.lit(64).alias("h"))
    chain = tiles.chained(tiles.pointwise(lambda v: 255 - v), tiles.smoothed)
    return tiles.processed(pixels, chain, whole=1, tile=24, overlap=8)


# ---- recorded spans


def span_log(spark, sf):
    """The table events as a log: some rows switch or reset the collection, the others begin, end (26 rows later) or mark."""
    k = c("event_id")
    kind = F.when(k % 50 == 0, "reset").when(k % 50 == 1, "enable").when(k % 50 == 27, "disable").when(k % 5 == 4, "event").when(k % 2 == 0, "begin").otherwise("end")
    attrs = F.when(k % 2 == 0, F.create_map(F.lit("user"), c("user_id").cast("string"), F.lit("state"), F.lit("open"))).otherwise(F.create_map(F.lit("state"), c("event_type")))
    return V.table(spark, sf, "events").select(
        kind.alias("kind"), k.alias("seq"), (V.micros("ts") * 1000).alias("t"), F.floor(k / 2 - F.when(k % 2 == 1, 13).otherwise(0)).alias("handle"), F.concat(c("event_type"), F.lit(":"), (c("user_id") % 10).cast("string")).alias("name"),
        c("event_type").alias("lane"), (k % 3).alias("detail"), c("user_id").alias("tid"), attrs.alias("attrs"),
    )


@query("""WITH l AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS t, event_id // 2 - CASE WHEN event_id % 2 = 1 THEN 13 ELSE 0 END AS handle, event_type || ':' || (user_id % 10) AS name, event_type AS lane, event_id % 3 AS detail, user_id AS tid,
  CASE WHEN event_id % 50 = 0 THEN 'reset' WHEN event_id % 50 = 1 THEN 'enable' WHEN event_id % 50 = 27 THEN 'disable' WHEN event_id % 5 = 4 THEN 'event' WHEN event_id % 2 = 0 THEN 'begin' ELSE 'end' END AS kind FROM events),
s AS (SELECT *, coalesce(last_value(CASE kind WHEN 'enable' THEN true WHEN 'disable' THEN false END IGNORE NULLS) OVER o, false) AS is_on, last_value(CASE WHEN kind IN ('enable', 'disable') THEN detail END IGNORE NULLS) OVER o AS level,
  last_value(CASE WHEN kind IN ('enable', 'reset') THEN t END IGNORE NULLS) OVER o AS epoch, last_value(CASE WHEN kind IN ('enable', 'reset') THEN seq END IGNORE NULLS) OVER o AS epoch_seq FROM l WINDOW o AS (ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
z AS (SELECT seq AS last FROM l WHERE kind IN ('enable', 'reset') ORDER BY t DESC, seq DESC LIMIT 1),
r AS (SELECT b.name, b.lane, greatest(b.t - e.epoch, 0) AS start_ns, e.t - b.t AS dur_ns, b.tid, e.seq, b.detail, 'state=' || e.lane || ',user=' || b.tid AS attrs, e.epoch, e.epoch_seq
  FROM s b JOIN s e ON e.handle = b.handle AND b.kind = 'begin' AND e.kind = 'end' AND b.is_on AND b.detail <= b.level AND (b.t, b.seq) < (e.t, e.seq)
  UNION ALL SELECT name, lane, t - epoch, 0, tid, seq, detail, CASE WHEN seq % 2 = 0 THEN 'state=open,user=' || tid ELSE 'state=' || lane END, epoch, epoch_seq FROM s WHERE kind = 'event' AND is_on AND detail <= level)
SELECT name, lane, start_ns, dur_ns, tid, seq, detail, attrs, epoch, epoch_seq IS NOT DISTINCT FROM (SELECT last FROM z) AS kept FROM r""")
def recorded_spans(spark, sf):
    text = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return recording.recorded(span_log(spark, sf)).withColumn("attrs", text)


@query(MERGED + f""", a AS (SELECT name, count(*) AS n, sum(dur_ns) / 1e9 AS total_s, min(dur_ns / 1e9) AS lo, max(dur_ns / 1e9) AS hi FROM spans GROUP BY name),
top AS (SELECT row_number() OVER (ORDER BY round(total_s, 6) DESC, name) AS pos, format('{{:<34s}} {{:6d}} {{:10.3f}} {{:9.1f}} {{:9.1f}} {{:9.1f}}', name, n, round(total_s, 6), round(total_s / n, 6) * 1000, lo * 1000, hi * 1000) AS line FROM a QUALIFY pos <= 20),
t AS (SELECT (max(start_ns + dur_ns) - min(start_ns)) / 1e9 AS wall FROM spans), b AS (SELECT lane, sum(end_ns - start_ns) / 1e9 AS busy FROM m GROUP BY lane),
u AS (SELECT row_number() OVER (ORDER BY round(busy, 6) DESC, lane) AS pos, format('  {{:<12s}} busy {{:8.3f}} s  ({{:4.1f}}%)', lane, round(busy, 6), round(busy / wall, 9) * 100) AS line FROM b, t),
x AS (SELECT 0 AS k, 0 AS pos, '{'stage':<34} {'count':>6} {'total s':>10} {'mean ms':>9} {'min ms':>9} {'max ms':>9}' AS line UNION ALL SELECT 1, 0, repeat('─', 82) UNION ALL SELECT 2, pos, line FROM top UNION ALL SELECT 3, 0, '' UNION ALL SELECT 4, 0, format('lane utilization over {{:.3f}} s wall:', wall) FROM t
  UNION ALL SELECT 5, pos, line FROM u UNION ALL SELECT 6, 0, '' UNION ALL SELECT 7, 0, '⚠️ DEBUG build: timings are NOT comparable')
SELECT row_number() OVER (ORDER BY k, pos) - 1 AS n, line FROM x""")
def summary_report(spark, sf):
    return S.report(V.spans(spark, sf), build="debug")


# ---- repeated runs

#: Lines of orders that share a task.
LINES = 1 << 18


@query("""WITH s AS (SELECT l_orderkey AS source, r AS run, row_number() OVER (PARTITION BY l_orderkey, r ORDER BY CASE WHEN l_orderkey % 4 = 1 AND r = 1 THEN -l_linenumber ELSE l_linenumber END, l_partkey, l_suppkey, l_extendedprice) AS place,
  CAST(round(l_quantity * 100) AS BIGINT) + CASE WHEN l_orderkey % 4 = 0 AND r = 2 AND l_linenumber % 2 = 1 THEN 1 ELSE 0 END AS size FROM lineitem, range(3) t(r) WHERE NOT (l_orderkey % 4 = 3 AND r = 2 AND l_linenumber = 2)),
c AS (SELECT source, run, count(*) AS frames, sum(size) AS bytes, string_agg(size::VARCHAR, ',' ORDER BY place) AS sizes FROM s GROUP BY ALL)
SELECT source, count(*) AS runs, (max(bytes) - min(bytes))::BIGINT AS spread, round((max(bytes) - min(bytes)) / min(bytes) * 1e6, 1) AS ppm, count(DISTINCT frames) AS frame_counts, count(DISTINCT sizes) AS sequences, count(DISTINCT sizes) = 1 AS repeats FROM c GROUP BY source""")
def run_census(spark, sf):
    """Three runs of each order: some repeat, some differ by a byte, in the order of frames, or by a frame.

    Lines are moved once, before there are three of each, to parts of so many lines as a task sorts in bounded memory.
    """
    k, n, r = c("l_orderkey"), c("l_linenumber"), c("run")
    held = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    held = held.repartition(max(spark.sparkContext.defaultParallelism, -(-held.count() // LINES)), "l_orderkey")
    lines = held.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("run")).where(~((k % 4 == 3) & (r == 2) & (n == 2)))
    order = sampling.Window.partitionBy("l_orderkey", "run").orderBy(F.when((k % 4 == 1) & (r == 1), -n).otherwise(n), "l_partkey", "l_suppkey", "l_extendedprice")
    size = F.round(c("l_quantity") * 100).cast("long") + F.when((k % 4 == 0) & (r == 2) & (n % 2 == 1), 1).otherwise(0)
    samples = lines.select(k.alias("source"), "run", F.row_number().over(order).alias("place"), size.alias("size"), (n == 1).alias("sync"))
    return census.repeats(census.runs(samples, ["source", "run"]), ["source"])


# ---- plans of sampling and encoding


@query(f"""WITH {V.PROFILES}, f AS (SELECT id, greatest(1, CAST(round(CASE WHEN fps > 0 THEN fps ELSE 30 END * (w / 100.0)) AS BIGINT)) AS n, CASE WHEN id % 3 = 0 THEN id % 7 - 1 END AS e FROM profiles)
SELECT id, CASE WHEN e IS NULL THEN greatest(1, n // 12) ELSE greatest(1, e) END::BIGINT AS stride, CASE WHEN e IS NULL THEN 16 ELSE 60 END AS cap FROM f""")
def sampling_plan(spark, sf):
    n = sampling.frame_count(c("fps"), c("w") / 100.0)
    return V.profiles(spark, sf).select("id", sampling.sampling_plan(n, F.when(c("id") % 3 == 0, c("id") % 7 - 1)).alias("p")).select("id", "p.*")


_NAMES = "['hevc', 'webH264', 'webH264Shrink']"


@query(f"""WITH {V.PROFILES}, s AS (SELECT id, w, h, bps, {_NAMES}[id % 3 + 1] AS profile FROM profiles)
SELECT id, s.profile, codec, bps * scale AS ceiling, max_qp, min_qp, look, audio FROM s JOIN (VALUES ('hevc', 'hevc', 1.0::DOUBLE, 38, 18, NULL, NULL), ('webH264', 'h264', 2.0, 34, 20, 16, 112000), ('webH264Shrink', 'h264', 1.0, 34, 20, 16, 112000)) t(profile, codec, scale, max_qp, min_qp, look, audio) ON t.profile = s.profile""")
def encode_profiles(spark, sf):
    """Each source with the knobs of its profile, and its ceiling; the presets are three rows, sent to every task."""
    presets = spark.createDataFrame(policy.PROFILES, policy.PROFILE_SCHEMA)
    name = F.element_at(F.array(*[F.lit(p[0]) for p in policy.PROFILES]), (c("id") % 3 + 1).cast("int"))
    sources = V.profiles(spark, sf).withColumn("profile", name).drop("codec")
    return sources.join(F.broadcast(presets), "profile").select("id", "profile", "codec", (c("bps") * c("ceiling_scale")).alias("ceiling"), "max_qp", "min_qp", c("look_ahead").alias("look"), c("audio_bps").alias("audio"))


@query(f"""WITH RECURSIVE b AS (SELECT * FROM ({_BITRATE})), i AS (SELECT id, best, best * (0.8 + id % 5 * 0.05) AS emitted, 60.0 + id % 35 AS target, CASE WHEN id % 4 <> 0 THEN 18 END AS corridor FROM b), r AS (
  SELECT id, target, best AS rate, emitted, 0 AS taken, best IS NULL OR corridor IS NULL OR coalesce(NOT emitted > 0, false) AS done, 0 AS n FROM i
  UNION ALL
  SELECT id, target, CASE WHEN ok THEN b ELSE rate END, CASE WHEN ok THEN e ELSE emitted END, CASE WHEN ok THEN taken + 1 ELSE taken END, NOT ok, n + 1 FROM (
    SELECT *, NOT done AND coalesce(p + 3 >= target AND e < emitted, false) AS ok FROM (SELECT *, {_RATE.format(b="b")} AS p, b * (0.9 + id % 3 * 0.1) AS e FROM (SELECT *, emitted * 0.92::DOUBLE AS b FROM r WHERE n < 3)))
) SELECT id, round(rate, 3) AS squeezed, taken AS squeezes FROM r WHERE n = 3""")
def corridor_squeeze(spark, sf):
    """The corridor gives three points more, and emits 0.9 to 1.1 times its rate."""
    found = _searched(spark, sf).withColumn("emitted", c("best") * (0.8 + c("id") % 5 * 0.05))
    out = search.squeezed(found, lambda b: _rate_score(b) + 3, lambda b: b * (0.9 + c("id") % 3 * 0.1), c("target"), F.when(c("id") % 4 != 0, 18))
    return out.select("id", F.round("squeezed", 3).alias("squeezed"), "squeezes")


# ---- signatures


@query(f"""WITH {PLANE64}, g AS (SELECT id, y, x, CAST(round(v * 250) AS INTEGER) AS b, CAST(round(d * 255) AS INTEGER) AS g, 255 - CAST(round(v * 250) AS INTEGER) AS r FROM plane64 WHERE x % 2 = 0 AND y % 2 = 0),
u AS (SELECT id, unnest([0, 1, 2]) AS channel, unnest([b, g, r]) // 32 AS bin FROM g), n AS (SELECT id, channel, bin, count(*) AS n FROM u GROUP BY ALL)
SELECT id, channel, bin, round(n / sum(n) OVER (PARTITION BY id), 9) AS share FROM n""")
def histogram_signature(spark, sf):
    """Three channels of planes of lineitem, 32 x 32 taps of 64 x 64 pixels."""
    v, d = F.round(c("v") * 250).cast("int"), F.round(c("d") * 255).cast("int")
    pixels = _plane64(spark, sf).select("id", "y", "x", F.lit(64).alias("w"), F.lit(64).alias("h"), F.array(v, d, 255 - v).alias("channels"))
    return planes.histogram(pixels, taps=32)

"""Queries of dense kernels as relations: similarity, octaves, consistency, warps of several channels; and rules that take options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planes as P
from ..operators import policy, search
from . import views as V
from .catalogue import _WITH, PLANE64, _planes64, _samples64
from .registry import query

c = F.col


def _pairs(spark, sf):
    """Planes a and b, each in one part; samples that the last plane lacks are 0 (4,095 rows at most, from one row).

    What is moved is a sample's place and quantity; planes are made of them afterwards.
    """
    samples = _samples64(spark, sf)
    last = samples.agg(F.max("k")).first()[0]
    if last is not None:
        n = last // 4096 + 1
        lacking = spark.range(last + 1, n * 4096).select(c("id").alias("k"), F.lit(0.0).alias("q"))
        samples = P.together(samples.unionByName(lacking), 4096, n, F.floor(c("k") / 4096))
    return _planes64(samples).select("id", "y", "x", c("v").alias("a"), c("d").alias("b"))


@query(f"""WITH {PLANE64}, full64 AS (SELECT id, y, x, v, d FROM plane64 UNION ALL SELECT id, k // 64, k % 64, 0, 0 FROM (SELECT id, unnest(range(n, 4096)) AS k FROM (SELECT id, count(*) AS n FROM plane64 GROUP BY id))), w AS (SELECT k, exp(-(k * k) / 4.5::DOUBLE) / (SELECT sum(exp(-(k * k) / 4.5::DOUBLE)) FROM range(-5, 6) a(k)) AS w FROM range(-5, 6) a(k)), t AS (SELECT o, least(greatest(o + k, 0), 63) AS i, sum(w) AS w FROM range(64) b(o), w GROUP BY ALL),
r AS (SELECT id, y, o AS x, sum(v * w) AS a, sum(d * w) AS b, sum(v * v * w) AS aa, sum(d * d * w) AS bb, sum(v * d * w) AS ab FROM full64 JOIN t ON t.i = x GROUP BY ALL),
m AS (SELECT id, o AS y, x, sum(a * w) AS a, sum(b * w) AS b, sum(aa * w) AS aa, sum(bb * w) AS bb, sum(ab * w) AS ab FROM r JOIN t ON t.i = r.y GROUP BY ALL),
s AS (SELECT id, (2 * (ab - a * b) + 9e-4) / (aa - a * a + bb - b * b + 9e-4) * (2 * a * b + 1e-4) / (a * a + b * b + 1e-4) AS v FROM m WHERE x BETWEEN 5 AND 58 AND y BETWEEN 5 AND 58)
SELECT id, round(avg(v), 6) AS ssim, round(min(v), 6) AS worst, count(*) AS n FROM s GROUP BY id""")
def ssim_map(spark, sf):
    return P.ssim(_pairs(spark, sf), 64, 64).groupBy("id").agg(F.round(F.avg("v"), 6).alias("ssim"), F.round(F.min("v"), 6).alias("worst"), F.count("*").alias("n"))


@query()
def per_octave_ssim(spark, sf):
    """Every band and what remains; tests compare it with planes in numpy."""
    found = P.octave_ssim(_pairs(spark, sf), 64, 64)
    of = lambda k: F.round(F.max(F.when(c("octave") == k, c("ssim"))), 6)
    return found.groupBy("id").agg(of(0).alias("base"), of(1).alias("band_1"), of(2).alias("band_2"))


@query()
def downsample_consistency(spark, sf):
    """Planes of 64 x 64 against half their size; tests compare it with planes in numpy."""
    p = _pairs(spark, sf)
    single = lambda v: c(v).cast("float").cast("double").alias("v")
    small = P.downscaled(p.select("id", "y", "x", single("a")), 64, 64).select("id", "y", "x", single("v"))
    found = P.downsample_consistency(small, p.select("id", "y", "x", single("b")), 32, 32, 64, 64)
    return found.select("id", *[F.round(x, 6).alias(x) for x in ("psnr", "ssim", "worst")])


_FLOWED = _WITH + """, f AS (SELECT id, y AS oy, x AS ox, x + 0.25::DOUBLE AS fx, y + 0.5::DOUBLE AS fy FROM planes), t AS (SELECT *, fx <= 7 AND fy <= 7 AS ok, least(7, floor(fx)::INT) AS x0, least(7, floor(fx)::INT + 1) AS x1, least(7, floor(fy)::INT) AS y0, least(7, floor(fy)::INT + 1) AS y1 FROM f),
g AS (SELECT t.id, oy AS y, ox AS x, ok, (a.v * 0.75 + b.v * 0.25) * 0.5 + (c.v * 0.75 + d.v * 0.25) * 0.5 AS v FROM t
  JOIN planes a ON a.id = t.id AND a.y = y0 AND a.x = x0 JOIN planes b ON b.id = t.id AND b.y = y0 AND b.x = x1 JOIN planes c ON c.id = t.id AND c.y = y1 AND c.x = x0 JOIN planes d ON d.id = t.id AND d.y = y1 AND d.x = x1)"""


@query(_FLOWED + """, s AS (SELECT p.id, p.y, p.x, p.v AS r, p.v / 2 AS g, 1 - p.v AS b, ok, g.v AS wr, g.v / 2 AS wg, 1 - g.v AS wb FROM planes p JOIN g ON g.id = p.id - 1 AND g.y = p.y AND g.x = p.x UNION ALL SELECT id, y, x, v, v / 2, 1 - v, false, 0, 0, 0 FROM planes WHERE id = (SELECT min(id) FROM planes)),
k AS (SELECT *, CASE WHEN ok THEN 0.5::DOUBLE * greatest(0, 1 - (abs(r - wr) + abs(g - wg) + abs(b - wb)) / 3 * (1 / 0.4::DOUBLE)) ELSE 0 END AS w FROM s)
SELECT id, y, x, round(w * wr + (1 - w) * r, 6) AS r, round(w * wg + (1 - w) * g, 6) AS g, round(w * wb + (1 - w) * b, 6) AS b FROM k""")
def channel_blend(spark, sf):
    """Each plane in three channels with the one before it, warped by a constant flow."""
    names = ("r", "g", "b")
    p = V.planes(spark, sf).select("id", "y", "x", c("v").alias("r"), (c("v") / 2).alias("g"), (1 - c("v")).alias("b"))
    flow = p.select("id", "y", "x", F.lit(0.25).alias("u"), F.lit(0.5).alias("w"))
    before = P.warped(p, flow, 8, 8, names).withColumn("id", c("id") + 1)
    return P.channel_blended(p, before, 0.5, 0.4, names).select("id", "y", "x", *[F.round(n, 6).alias(n) for n in names])


@query(_WITH + """, q AS (SELECT 8 AS n, 16 AS m UNION ALL SELECT 8, 12), f AS (SELECT m, o, greatest(0, (o + 0.5::DOUBLE) * n / m - 0.5) AS f FROM q, range(16) b(o) WHERE o < m), t AS (SELECT m, o, least(7, floor(f)::INT) AS i, 1 - (f - floor(f)) AS w FROM f UNION ALL SELECT m, o, least(7, floor(f)::INT + 1), f - floor(f) FROM f),
a AS (SELECT id, y, o AS x, sum(v * w) AS u, sum((1 - v) * w) AS w FROM planes JOIN t ON t.i = planes.x AND m = 16 GROUP BY id, y, o)
SELECT id, o AS y, x, round(sum(u * t.w) * 2, 6) AS u, round(sum(a.w * t.w) * 1.5, 6) AS w FROM a JOIN t ON t.i = a.y AND m = 12 GROUP BY id, o, x""")
def flow_resample(spark, sf):
    """Flow of 8 x 8 on a grid of 16 x 12: displacements grow twofold and by half."""
    flow = V.planes(spark, sf).select("id", "y", "x", c("v").alias("u"), (1 - c("v")).alias("w"))
    return P.scaled_flow(flow, 8, 8, 16, 12).select("id", "y", "x", F.round("u", 6).alias("u"), F.round("w", 6).alias("w"))


# ---- rules that take options

_DECLARED = ["public.png", "public.heif", "public.camera-raw-image", "com.example.other", None]


@query("""WITH p AS (SELECT page_id AS id, ['public.png', 'public.heif', 'public.camera-raw-image', 'com.example.other', NULL][page_id % 5 + 1] AS declared, ['JPG', 'dng', 'xyz'][page_id % 3 + 1] AS ext FROM pages),
f AS (SELECT id, CASE declared WHEN 'public.png' THEN 'png' WHEN 'public.heif' THEN 'heic' WHEN 'public.camera-raw-image' THEN 'raw' ELSE CASE ext WHEN 'JPG' THEN 'jpeg' WHEN 'dng' THEN 'raw' ELSE 'unknown' END END AS format FROM p)
SELECT id, format, CASE WHEN format = 'raw' THEN 'raw' ELSE 'image' END AS route, CASE WHEN format = 'raw' AND id % 4 <> 1 THEN 'deferred' ELSE 'ready' END AS status FROM f""")
def declared_formats(spark, sf):
    """Declared types come before extensions; bodies that the raw decoder doesn't support, or of which nothing is known, are deferred."""
    k = c("page_id")
    path = F.concat(F.lit("c."), F.element_at(F.array(*map(F.lit, ("JPG", "dng", "xyz"))), (k % 3 + 1).cast("int")))
    declared = F.get(F.array(*map(F.lit, _DECLARED)), (k % 5).cast("int"))
    rows = V.table(spark, sf, "pages").select(k.alias("id"), policy.still_format(path, declared).alias("format"), policy.still_route(path, declared).alias("route"))
    return rows.withColumn("status", policy.still_status(c("route"), F.when(c("id") % 4 == 1, True).when(c("id") % 4 == 2, False)))


@query("""SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 3 <> 0 THEN 'exposure=' || (p_partkey % 3 - 1)::DOUBLE END, CASE WHEN p_size % 2 = 0 THEN 'noise=' || (p_size % 5)::DOUBLE END], lambda x: x IS NOT NULL), ',') AS settings,
CASE WHEN p_partkey % 4 = 0 THEN 'metal' WHEN p_partkey % 2 = 0 THEN 'gpu' ELSE 'cpu' END AS backend FROM part""")
def optional_settings(spark, sf):
    """A knob that is null isn't touched, one that is 0 is; an explicit scoring backend wins over what a closure implies."""
    k = c("p_partkey")
    made = policy.raw_options({"exposure": F.when(k % 3 != 0, k % 3 - 1), "noise": F.when(c("p_size") % 2 == 0, c("p_size") % 5)})
    text = F.array_join(F.transform(F.map_entries(made), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    backend = search.scoring_backend(F.when(k % 4 == 0, "metal"), k % 2 == 0)
    return V.table(spark, sf, "part").select(k.alias("id"), text.alias("settings"), backend.alias("backend"))

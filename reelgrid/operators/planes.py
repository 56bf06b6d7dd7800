"""Plane mathematics on relational planes: rows (id, y, x, v) of a plane of known size.

Neighbours are reached by exploding each sample to the outputs that it feeds, so every operator is
one aggregation by (id, y, x) with partial sums, and no join.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fed(planes: DataFrame, axis: str, n: int, weights: list[list[tuple[int, float]]], columns: tuple[str, ...] = ("v",), kept: tuple[str, ...] = ()) -> DataFrame:
    """Sums of columns along an axis: weights[i] are the (output, weight) pairs that sample i feeds; columns of kept stay as they are."""
    # One literal, folded once: a table of many small expressions takes longer to plan than to use.
    table = F.from_json(F.lit(json.dumps([[{"o": o, "w": float(w)} for o, w in row] for row in weights])), "array<array<struct<o:int,w:double>>>")
    rows = planes.select("*", F.explode(F.get(table, F.col(axis))).alias("f"))
    keys = ["id", *[F.col("f.o").alias(a) if a == axis else F.col(a) for a in ("y", "x")]]
    same = [F.sum(F.when(F.col("f.o") == F.col(axis), F.col(c))).alias(c) for c in kept]
    return rows.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("f.w")).alias(c) for c in columns], *same)


#: Samples of the planes that share a task.
SAMPLES = 1 << 17


def together(planes: DataFrame, samples: int, n: int, plane: Column | str = "id") -> DataFrame:
    """n planes of so many samples, whole planes (told by plane) in one part: sums along their axes then move nothing again."""
    session = planes.sparkSession.sparkContext
    return planes.repartition(max(session.defaultParallelism, -(-n * samples // SAMPLES)), plane)


def _clamped(n: int, taps: list[tuple[int, float]]) -> list[list[tuple[int, float]]]:
    """Filter taps (offset, weight) of each output, turned round; beyond the edge, the edge counts."""
    feeds: list[dict[int, float]] = [{} for _ in range(n)]
    for o in range(n):
        for k, w in taps:
            i = min(max(o + k, 0), n - 1)
            feeds[i][o] = feeds[i].get(o, 0.0) + w
    return [sorted(f.items()) for f in feeds]


def gaussian(sigma: float, radius: int) -> list[tuple[int, float]]:
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [(i - radius, w / sum(raw)) for i, w in enumerate(raw)]


def blurred(planes: DataFrame, w: int, h: int, sigma: float = 1.5, radius: int = 6, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    taps = gaussian(sigma, radius)
    return _fed(_fed(planes, "x", w, _clamped(w, taps), columns), "y", h, _clamped(h, taps), columns)


def downscaled(planes: DataFrame, w: int, h: int, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Means of 2 x 2 boxes; a missing column or row is the last one again."""
    return _fed(_fed(planes, "x", w, _half(w), columns), "y", h, _half(h), columns)


def _half(n: int) -> list[list[tuple[int, float]]]:
    return [[(i // 2, 1.0 if n % 2 and i == n - 1 else 0.5)] for i in range(n)]


def _smooth(n: int) -> list[list[tuple[int, float]]]:
    """Half of an axis and back again, as one step."""
    back = bilinear_weights(-(-n // 2), n)
    return [[(o, w * p) for k, w in row for o, p in back[k]] for row in _half(n)]


def laplacian(pairs: DataFrame, w: int, h: int) -> DataFrame:
    """Planes a and b without what their halves keep of them; samples go along with what becomes of them, so no join brings both together."""
    across = _fed(pairs.select("*", F.col("a").alias("_a"), F.col("b").alias("_b")), "x", w, _smooth(w), ("_a", "_b"), ("a", "b"))
    m = _fed(across, "y", h, _smooth(h), ("_a", "_b"), ("a", "b"))
    return m.select("id", "y", "x", (F.col("a") - F.col("_a")).alias("a"), (F.col("b") - F.col("_b")).alias("b"))


#: Stabilisers of structural similarity, and its window (fixed values).
C1, C2, SSIM_RADIUS = 1e-4, 9e-4, 5


def ssim(pairs: DataFrame, w: int, h: int, luminance: bool = True) -> DataFrame:
    """id, y, x, v: structural similarity of planes a and b (id, y, x, a, b), without the border that the window doesn't fit.

    All five statistics are blurred together: two aggregations, whatever they are of.
    """
    if min(w, h) < 2 * SSIM_RADIUS + 1:
        raise ValueError("plane too small")
    a, b = F.col("a"), F.col("b")
    rows = pairs.select("id", "y", "x", "a", "b", (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab"))
    m = blurred(rows, w, h, 1.5, SSIM_RADIUS, ("a", "b", "aa", "bb", "ab"))
    v1, v2, cov = F.col("aa") - a * a, F.col("bb") - b * b, F.col("ab") - a * b
    value = (2 * cov + C2) / (v1 + v2 + C2)
    if luminance:
        value = value * (2 * a * b + C1) / (a * a + b * b + C1)
    inner = F.col("x").between(SSIM_RADIUS, w - 1 - SSIM_RADIUS) & F.col("y").between(SSIM_RADIUS, h - 1 - SSIM_RADIUS)
    return m.where(inner).select("id", "y", "x", value.alias("v"))


def octave_ssim(pairs: DataFrame, w: int, h: int, octaves: int = 4) -> DataFrame:
    """id, octave, ssim: the mean of each Laplacian band, finest first from 1, without luminance, and as octave 0 that of what remains, with it."""
    found, k = [], 0
    mean = lambda d, n: d.groupBy("id").agg(F.lit(n).alias("octave"), F.avg("v").alias("ssim"))
    while k < octaves and min(w, h) >= 2 * (2 * SSIM_RADIUS + 1):
        k += 1
        found.append(mean(ssim(laplacian(pairs, w, h), w, h, False), k))
        pairs, w, h = downscaled(pairs, w, h, ("a", "b")), -(-w // 2), -(-h // 2)
    out = mean(ssim(pairs, w, h), 0)
    for x in found:
        out = out.unionByName(x)
    return out


def downsample_consistency(source: DataFrame, result: DataFrame, w: int, h: int, result_w: int, result_h: int, tile: int = 8) -> DataFrame:
    """id, psnr, ssim, worst (tile's mean similarity): of a result (id, y, x, v) reduced by area onto its source."""
    if result_w < w or result_h < h:
        raise ValueError("result is smaller than its source")
    back = area_resampled(result, result_w, result_h, w, h).withColumnRenamed("v", "b")
    both = source.select("id", "y", "x", F.col("v").alias("a"), F.lit(None).cast("double").alias("b")).unionAll(back.select("id", "y", "x", F.lit(None).cast("double").alias("a"), "b"))
    pairs = both.groupBy("id", "y", "x").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a is not null and b is not null")
    error = pairs.groupBy("id").agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("_mse")).select("id", psnr(F.col("_mse")).alias("psnr"))
    near = tiles(ssim(pairs, w, h), tile).groupBy("id").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("ssim"), F.min("mean").alias("worst"))
    return error.join(near, "id")


def area_weights(n: int, m: int) -> list[list[tuple[int, float]]]:
    """Shares of n samples in m outputs by overlap."""
    ratio, feeds = n / m, [[] for _ in range(n)]
    for o in range(m):
        lo, hi = o * ratio, (o + 1) * ratio
        parts = [(i, min(i + 1, hi) - max(i, lo)) for i in range(int(lo), min(n, math.ceil(hi)))]
        total = sum(p for _, p in parts if p > 0)
        for i, p in parts:
            if p > 0:
                feeds[i].append((o, p / total))
    return feeds


def area_resampled(planes: DataFrame, w: int, h: int, to_w: int, to_h: int) -> DataFrame:
    if (w, h) == (to_w, to_h):
        return planes.select("id", "y", "x", "v")
    across = _fed(planes, "x", w, area_weights(w, to_w)).withColumn("v", F.col("v").cast("float").cast("double"))
    return _fed(across, "y", h, area_weights(h, to_h)).withColumn("v", F.col("v").cast("float").cast("double"))


def bilinear_weights(n: int, m: int) -> list[list[tuple[int, float]]]:
    """Half-pixel centres, clamped at both ends."""
    feeds: list[dict[int, float]] = [{} for _ in range(n)]
    for o in range(m):
        f = max(0.0, (o + 0.5) * n / m - 0.5)
        a = min(n - 1, int(f))
        for i, p in ((a, 1 - (f - a)), (min(n - 1, a + 1), f - a)):
            feeds[i][o] = feeds[i].get(o, 0.0) + p
    return [sorted(x.items()) for x in feeds]


def expanded(planes: DataFrame, w: int, h: int, to_w: int, to_h: int, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    return _fed(_fed(planes, "x", w, bilinear_weights(w, to_w), columns), "y", h, bilinear_weights(h, to_h), columns)


def scaled_flow(flow: DataFrame, w: int, h: int, to_w: int, to_h: int) -> DataFrame:
    """Flow (id, y, x, u, w) on another grid; displacements grow with their axis."""
    out = expanded(flow, w, h, to_w, to_h, ("u", "w"))
    return out.select("id", "y", "x", (F.col("u") * (to_w / w)).alias("u"), (F.col("w") * (to_h / h)).alias("w"))


def nearest_resized(planes: DataFrame, w: int, h: int, to_w: int, to_h: int) -> DataFrame:
    pick = lambda n, m: [[(o, 1.0) for o in range(m) if o * n // m == i] for i in range(n)]
    return _fed(_fed(planes, "x", w, pick(w, to_w)), "y", h, pick(h, to_h))


def point_sampled(planes: DataFrame, w: int, h: int, to_w: int, to_h: int) -> DataFrame:
    """The samples at the centres of a grid of cells, by integer division."""
    pick = lambda n, m: [[(o, 1.0) for o in range(m) if o * n // m + n // (2 * m) == i] for i in range(n)]
    return _fed(_fed(planes, "x", w, pick(w, to_w)), "y", h, pick(h, to_h))


def psnr(mse: Column) -> Column:
    """Over [0, 1]; infinite where nothing differs."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.log10(1.0 / F.when(mse > 0, mse)) * 10)


def tiles(planes: DataFrame, size: int) -> DataFrame:
    """Means of tiles, at least 8 wide; the last ones may be partial."""
    s = max(8, size)
    return planes.groupBy("id", F.floor(F.col("y") / s).alias("tile_y"), F.floor(F.col("x") / s).alias("tile_x")).agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


def pooled(planes: DataFrame) -> DataFrame:
    """mean(d) and the fourth root of mean(d^4), of absolute samples."""
    d = F.abs("v")
    return planes.groupBy("id").agg(F.round(F.avg(d), 6).alias("l1"), F.round(F.sqrt(F.sqrt(F.avg(d * d * d * d))), 6).alias("l4"))


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luma601(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def luma709(r: Column, g: Column, b: Column) -> Column:
    return (r * 0.2126 + g * 0.7152 + b * 0.0722) / 255.0


def positive_xyb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Opponent colours of linear RGB, shifted to be positive."""
    bias = 0.0037930732552754493
    root = lambda m: F.cbrt(m + bias) - bias ** (1 / 3)
    l, m, s = root(r * 0.30 + g * 0.622 + b * 0.078), root(r * 0.23 + g * 0.692 + b * 0.078), root(r * 0.24342268924547819 + g * 0.20476744424496821 + b * 0.5518098657995536)
    y = (l + m) * 0.5
    return (l - m) * 0.5 * 14.0 + 0.42, y + 0.01, s - y + 0.55


def warped(planes: DataFrame, flow: DataFrame, w: int, h: int, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Backward warp: each pixel of flow (id, y, x, u, w) samples the plane at (x+u, y+w), bilinearly; outside is null.

    Each pixel asks for its four neighbours; asks and samples meet on (id, y, x).
    """
    fx, fy = F.col("x") + F.col("u"), F.col("y") + F.col("w")
    inside = (fx >= 0) & (fy >= 0) & (fx <= w - 1) & (fy <= h - 1)
    ask = flow.select("id", F.col("y").alias("oy"), F.col("x").alias("ox"), fx.alias("fx"), fy.alias("fy"), inside.alias("valid"))
    ask = ask.withColumn("x0", F.floor("fx")).withColumn("y0", F.floor("fy"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    ask = ask.withColumn("c", corner)
    share = F.when(F.col("c.a") == 0, 1 - (F.col("fx") - F.col("x0"))).otherwise(F.col("fx") - F.col("x0")) * F.when(F.col("c.b") == 0, 1 - (F.col("fy") - F.col("y0"))).otherwise(F.col("fy") - F.col("y0"))
    ask = ask.withColumn("share", share).withColumn("x", F.least(F.lit(w - 1), F.col("x0") + F.col("c.a")).cast("int")).withColumn("y", F.least(F.lit(h - 1), F.col("y0") + F.col("c.b")).cast("int"))
    met = ask.join(planes, ["id", "y", "x"], "left")
    return met.groupBy("id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(*[F.when(F.first("valid"), F.sum(F.col("share") * F.col(c))).alias(c) for c in columns])


def channel_blended(fresh: DataFrame, moved: DataFrame, strength: float, tolerance: float, columns: tuple[str, ...]) -> DataFrame:
    """Confidence blend of warped channels with fresh ones: one agreement a pixel, from the mean difference of its channels; where nothing was warped the fresh ones stay."""
    was = moved.withColumnsRenamed({c: f"_{c}" for c in columns})
    rows = fresh.join(was, ["id", "y", "x"], "left")
    gap = sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in columns), F.lit(0.0)) / len(columns)
    share = F.coalesce(F.greatest(F.lit(0.0), 1 - gap * (1 / tolerance if tolerance > 0 else 0.0)) * strength, F.lit(0.0))
    rows = rows.withColumn("_w", F.when(F.col(f"_{columns[0]}").isNull(), 0.0).otherwise(share))
    return rows.select("id", "y", "x", *[(F.col("_w") * F.coalesce(f"_{c}", F.lit(0.0)) + (1 - F.col("_w")) * F.col(c)).alias(c) for c in columns])


def histogram(pixels: DataFrame, bins: int = 8, taps: int = 64) -> DataFrame:
    """id, channel, bin, share: of pixels (id, y, x, w, h, channels: an array of whole numbers from 0 to 255).

    About taps x taps pixels on a fixed grid count, so that the work on a frame doesn't grow with it;
    shares of all channels sum to one.
    """
    step = lambda n: F.greatest(F.lit(1), F.floor(F.col(n) / taps))
    shift = 8 - round(math.log2(bins))
    taken = pixels.where((F.col("x") % step("w") == 0) & (F.col("y") % step("h") == 0))
    each = taken.select("id", F.posexplode("channels").alias("channel", "_v")).groupBy("id", "channel", F.shiftright(F.col("_v").cast("int"), shift).alias("bin")).agg(F.count("*").alias("_n"))
    return each.select("id", "channel", "bin", F.round(F.col("_n") / F.sum("_n").over(Window.partitionBy("id")), 9).alias("share"))

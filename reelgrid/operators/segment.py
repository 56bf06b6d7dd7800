"""Segmentation of frame sequences: distances, adaptive thresholds, cuts and shots.

Decisions that depend on earlier decisions are folds that stream over a clip's frames (folds.py);
thresholds of a whole clip are order statistics of counts (prefix.py). No clip is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds, prefix


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences; the largest float where lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(3.4028234663852886e38))


def mean_abs(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), l1(a, b) / F.size(a))


def lagged(frames: DataFrame) -> DataFrame:
    """Each frame with the distance to the one before it in its clip; the first has none."""
    before = F.lag("signature").over(Window.partitionBy("clip").orderBy("idx"))
    return frames.withColumn("before", before).where("before IS NOT NULL")


def thresholds(deltas: DataFrame, k: float, scale: str, floor: float = 0.01) -> DataFrame:
    """clip, total and t: the adaptive threshold of each clip: upper tail, or median absolute deviation (upper medians)."""
    counts = prefix.states(deltas, ["clip"], "score")
    middle = F.floor(F.col("total") / 2)
    if scale != "mad":
        found = prefix.order_statistics(counts, ["clip"], "score", {"m": middle, "p": F.round((F.col("total") - 1) * 0.9)})
        return found.select("clip", "total", (F.col("p") + F.greatest(F.col("p") - F.col("m"), F.lit(floor)) * k).alias("t"))
    middles = prefix.order_statistics(counts, ["clip"], "score", {"m": middle}).select(F.col("clip").alias("_clip"), "m")
    off = counts.join(middles, F.col("clip").eqNullSafe(F.col("_clip"))).select("clip", "m", F.abs(F.col("score") - F.col("m")).alias("off"), "n")
    spread = prefix.order_statistics(off.groupBy("clip", "off").agg(F.sum("n").alias("n")), ["clip"], "off", {"mad": middle})
    return spread.join(middles, F.col("clip").eqNullSafe(F.col("_clip"))).select("clip", "total", (F.col("m") + F.greatest(F.col("mad"), F.lit(floor)) * k).alias("t"))


def two_pass_cuts(deltas: DataFrame, k: float = 2.0, scale: str = "tail", floor: float = 0.01) -> DataFrame:
    """Local maxima strictly above the clip's threshold; none with two deltas or fewer."""
    own = Window.partitionBy("clip").orderBy("idx")
    near = deltas.select("clip", F.col("idx").cast("long").alias("idx"), "score", F.lag("score", 1, 0.0).over(own).alias("_a"), F.lead("score", 1, 0.0).over(own).alias("_b"))
    limits = thresholds(deltas, k, scale, floor).where("total > 2").withColumnRenamed("clip", "_clip")
    rows = near.join(limits, F.col("clip").eqNullSafe(F.col("_clip")))
    return rows.where((F.col("score") > F.col("t")) & (F.col("score") >= F.col("_a")) & (F.col("score") >= F.col("_b"))).select("clip", "idx", F.round("t", 6).alias("threshold"))


def causal_cuts(deltas: DataFrame, k: float = 2.0, scale: str = "tail", floor: float = 0.01, window: int = 48, history: int = 12, gap: int = 6) -> DataFrame:
    """Cuts (clip, idx) decided frame by frame, as folds.CutDetector says."""
    return folds.folded(deltas, lambda: folds.CutDetector(k=k, floor=floor, size=window, history=history, gap=gap, mad=scale == "mad"), "idx long")


def shots(deltas: DataFrame, limit: float = 0.35, gap: int = 6) -> DataFrame:
    """Starts (clip, start) of shots; the distance of a clip's first frame doesn't count."""
    return folds.folded(deltas, lambda: folds.Shots(limit, gap), "start long")


def blended(samples: DataFrame, strength: float, tolerance: float) -> DataFrame:
    """Confidence blend of each sample with the blended one before it; the first passes through."""
    return folds.folded(samples, lambda: folds.Blend(strength, tolerance), "idx long, v double").withColumn("v", F.round("v", 6))


def shot_blended(samples: DataFrame, strength: float, tolerance: float, **detector) -> DataFrame:
    """clip, idx, cut, v: as blended(), but the blend starts anew at each cut that the causal detector finds."""
    return folds.folded(samples, lambda: folds.ShotBlend(folds.CutDetector(**detector), folds.Blend(strength, tolerance)), "idx long, cut boolean, v double")


def stability(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute change from sample to sample, and the pairs it covers; none without pairs."""
    change = F.abs(F.col("score") - F.lag("score").over(Window.partitionBy("clip").orderBy("idx")))
    return samples.withColumn("c", change).groupBy(*keys).agg(F.round(F.try_divide(F.sum("c"), F.count("c")), 6).alias("flicker"), F.count("c").alias("pairs"))


def channel_stability(frames: DataFrame, keys: list[str]) -> DataFrame:
    """As stability(), of frames (clip, idx, signature) with several channels: the change is the mean over channels."""
    before = F.lag("signature").over(Window.partitionBy("clip").orderBy("idx"))
    changed = frames.withColumn("c", mean_abs(F.col("signature"), before))
    return changed.groupBy(*keys).agg(F.round(F.try_divide(F.sum("c"), F.count("c")), 6).alias("flicker"), F.count("c").alias("pairs"))


def reduction(before: Column, after: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(after, before)), F.lit(0.0))

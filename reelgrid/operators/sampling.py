"""Sampling of frame streams, score aggregates and pairing of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix
from .shared import checkpointed


def score_aggregate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """mean, minimum, p10 at the floored index, count."""
    return scores.groupBy(*keys).agg(F.round(F.avg("score"), 9).alias("mean"), F.min("score").alias("minimum"), F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY score)").alias("p10"), F.count("*").alias("n"))


def strided(frames: DataFrame, stride: int, offset: int, cap: int) -> DataFrame:
    """Every stride-th frame from offset on, the first cap of each clip. Indices are dense, so the cap is a bound on them."""
    s = max(1, stride)
    return frames.where((F.col("idx") >= offset) & ((F.col("idx") - offset) % s == 0) & (F.col("idx") < offset + s * cap))


def frame_count(fps: Column, seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.round(F.when(fps > 0, fps).otherwise(30.0) * seconds).cast("long"))


def stride_for(frames: Column, least: int = 12) -> Column:
    """Stride that scores about `least` frames: integer division, at least 1."""
    return F.greatest(F.lit(1), F.floor(frames / max(1, least)))


def sampling_plan(frames: Column, explicit: Column, least: int = 12, most: int = 16) -> Column:
    """stride and cap: about least frames, most at most; an explicit stride is kept, with a cap of 60."""
    return F.struct(F.when(explicit.isNotNull(), F.greatest(F.lit(1), explicit)).otherwise(stride_for(frames, least)).cast("long").alias("stride"), F.when(explicit.isNull(), most).otherwise(60).alias("cap"))


def refined(frames: DataFrame, stride: int, cap: int) -> DataFrame:
    """A first pass and a second one of the same stride, half a stride later."""
    return strided(frames, stride, 0, cap).unionAll(strided(frames, stride, max(1, stride // 2), cap))


def near_gate(aggregates: DataFrame, target: float, margin: float = 1.5, stride: int = 2) -> DataFrame:
    """Clips so near the target that a second pass is due; with a stride of 1 every frame is scored already."""
    return aggregates.where((F.abs(F.col("p10") - target) < margin) & F.lit(stride > 1))


def positional(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frame i with frame i of the same clip, up to the end of the shorter."""
    return a.select("clip", "idx", F.col("score").alias("a")).join(b.select("clip", "idx", F.col("score").alias("b")), ["clip", "idx"])


def nearest(reference: DataFrame, other: DataFrame, tolerance: int, by: list[str] | None = None) -> DataFrame:
    """Each (ref_id, pts) with the nearest (other_id, pts) within the tolerance, of its own clip (by); ties go to the later.

    An as-of join both ways over one order of both sides: each reference has two candidates, the last
    frame up to it and the first one after it, in its part or, by one summary row, in another. Of
    frames of one time the one with the largest id counts. References without a time have none.
    """
    by = by or []
    frames = other.where(F.col("pts").isNotNull()).groupBy(*by, "pts").agg(F.max("other_id").alias("other_id"))
    kind = other.schema["other_id"].dataType.simpleString()
    both = frames.select(*by, "pts", F.struct("pts", F.col("other_id").alias("id")).alias("_of"), F.lit(None).cast(reference.schema["ref_id"].dataType).alias("ref_id"), F.lit(0).alias("_ref"))
    both = both.unionByName(reference.where(F.col("pts").isNotNull()).select(*by, "pts", F.lit(None).cast(f"struct<pts:{other.schema['pts'].dataType.simpleString()},id:{kind}>").alias("_of"), "ref_id", F.lit(1).alias("_ref")))
    rows = prefix.dealt(both, by, ["pts", "_ref", "ref_id"])
    ends = rows.groupBy(*by, prefix.PART).agg(F.max("_of").alias("_last"), F.min("_of").alias("_first"))
    ends = ends.select(*by, prefix.PART, F.max("_last").over(prefix.earlier(by)).alias("_low"), F.min("_first").over(prefix.later(by)).alias("_high"))
    upto = lambda *order: prefix.within(by, *order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select(
        *by, prefix.PART, "pts", "ref_id", "_ref",
        F.last("_of", ignorenulls=True).over(upto("pts", "_ref")).alias("_a"), F.last("_of", ignorenulls=True).over(upto(F.desc("pts"), F.desc("_ref"))).alias("_b"),
    ).where("_ref = 1")
    told = prefix.with_summary(found, ends, by).withColumns({"_a": F.coalesce("_a", "_low"), "_b": F.coalesce("_b", "_high")})
    before, after = F.col("pts") - F.col("_a.pts"), F.col("_b.pts") - F.col("pts")
    best = F.when(after.isNull() | (before < after), F.col("_a")).otherwise(F.col("_b"))
    out = told.withColumn("_best", best).where(F.abs(F.col("_best.pts") - F.col("pts")) <= tolerance)
    return out.select(*by, "ref_id", F.col("pts").alias("ref_pts"), F.col("_best.id").alias("other_id"), F.col("_best.pts").alias("other_pts"))


def matched(reference: DataFrame, pairs: DataFrame, cap: int) -> DataFrame:
    """Per clip the references with a partner, up to the cap-th, and those skipped before it is reached.

    reference: (clip, ref_id, pts); pairs: rows of nearest(). A reference without pts is last, and skipped.
    """
    hit = reference.join(pairs.select(F.col("ref_id").alias("_ref"), F.lit(True).alias("_hit")), F.col("ref_id") == F.col("_ref"), "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    before = Window.partitionBy("clip").orderBy(F.col("pts").asc_nulls_last(), "ref_id").rowsBetween(Window.unboundedPreceding, -1)
    within = hit.withColumn("_n", F.coalesce(F.sum(F.col("_hit").cast("long")).over(before), F.lit(0))).where(F.col("_n") < cap)
    return within.groupBy("clip").agg(F.count_if("_hit").alias("matched"), F.count_if(~F.col("_hit")).alias("skipped"))


def neighbours(frames: DataFrame, column: str) -> DataFrame:
    """Each frame with what at most one frame before and two after it hold, in order: arrays before and after."""
    own = Window.partitionBy("clip").orderBy("idx")
    return frames.select("*", F.collect_list(column).over(own.rowsBetween(-1, -1)).alias("before"), F.collect_list(column).over(own.rowsBetween(1, 2)).alias("after"))


def check_frames(count: Column) -> Column:
    """The first and the last of so many frames, once if they are the same; none of none."""
    return F.when(count > 0, F.array_distinct(F.array(F.lit(0).cast("long"), count.cast("long") - 1))).otherwise(F.array().cast("array<bigint>"))


def noise_probe(frames: DataFrame, limit: float = 90.0, stride: int = 5) -> DataFrame:
    """Per clip the mean score of every stride-th frame, and whether it is below the limit: noisy."""
    mean = F.avg("score")
    return frames.where(F.col("idx") % stride == 0).groupBy("clip").agg(F.round(mean, 6).alias("probe"), (mean < limit).alias("noisy"))


def frame_rate(frames: DataFrame) -> DataFrame:
    """Per clip: 1e6 over the upper median of the positive gaps of pts_us; 30 with fewer than two stamps.

    The median is an order statistic of counted gaps, of which a clip has few.
    """
    gap = F.col("pts_us") - F.lag("pts_us").over(Window.partitionBy("clip").orderBy("pts_us"))
    gaps = frames.select("clip", gap.alias("gap"))
    clips = gaps.groupBy("clip").agg(F.lit(1).alias("_one")).drop("_one")
    middle = prefix.order_statistics(prefix.states(gaps.where("gap > 0"), ["clip"], "gap"), ["clip"], "gap", {"m": F.floor(F.col("total") / 2)})
    found = clips.join(middle.select(F.col("clip").alias("_clip"), "m"), F.col("clip").eqNullSafe(F.col("_clip")), "left")
    return found.select("clip", F.coalesce(F.round(F.try_divide(F.lit(1e6), F.col("m")), 9), F.lit(30.0)).alias("fps"))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """rows (of them the columns keep, or all) with their place in the order, from 0, within each group of by (or of all rows).

    Parts are sorted where they were dealt, and their rows counted on: nothing is moved again.
    """
    keep = rows.columns if keep is None else keep
    run = F.col("_run")
    sorted_rows = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_run", F.monotonically_increasing_id())
    # The upper bits of such a number tell the part, the lower ones, up to 2^33, the place in it.
    parts = checkpointed(sorted_rows.select(*dict.fromkeys([*by, *keep]), "_run")).withColumn(prefix.PART, F.shiftright(run, 33))
    counts = parts.groupBy(*by, prefix.PART).agg(F.count("*").alias("_n"), F.min("_run").alias("_start"))
    start = F.coalesce(F.sum("_n").over(prefix.earlier(by)), F.lit(0)) - F.col("_start")
    counts = counts.select(*by, prefix.PART, start.alias("_before"))
    # Without groups there is one row for each part.
    return prefix.with_summary(parts, counts if by else F.broadcast(counts), by).select(*keep, (F.col("_before") + run).alias(name))


def reordered(packets: DataFrame) -> DataFrame:
    """Packets with their place in presentation order, for each track."""
    return numbered(packets, ["track"], ["pts", "tie"], "place")


def audio_chunks(streams: DataFrame, frames_per_chunk: int) -> DataFrame:
    """(id, frames, rate) -> one row per chunk with its offset, length and pts in ns."""
    rows = streams.where("frames > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(frames_per_chunk).cast("long"))).alias("offset"))
    return rows.select("id", "offset", F.least(F.lit(frames_per_chunk), F.col("frames") - F.col("offset")).alias("length"), F.round(F.col("offset") / F.col("rate") * 1e9).cast("long").alias("pts_ns"))

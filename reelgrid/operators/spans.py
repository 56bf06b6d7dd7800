"""Span analytics: grouping, interval union, utilization, caps and exports.

A span is a row (name, lane, start_ns, dur_ns, tid, seq, detail, attrs); seq is the order in which
spans were appended. Interval union is a prefix scan (prefix.py), so that a lane with most of the
spans isn't one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def aggregate(spans: DataFrame) -> DataFrame:
    """Per name: lane first appended, count, total, min, max and mean seconds."""
    d = F.col("dur_ns") / 1e9
    return spans.groupBy("name").agg(
        F.min_by("lane", "seq").alias("lane"),
        F.count("*").alias("n"),
        F.round(F.sum("dur_ns") / 1e9, 6).alias("total_s"),
        F.min(d).alias("min_s"),
        F.max(d).alias("max_s"),
        F.round(F.sum("dur_ns") / 1e9 / F.count("*"), 6).alias("mean_s"),
    )


def timeline(spans: DataFrame) -> DataFrame:
    """One row: seconds from the first start to the last end; 0 without spans."""
    return spans.agg(F.coalesce((F.max(F.col("start_ns") + F.col("dur_ns")) - F.min("start_ns")) / 1e9, F.lit(0.0)).alias("timeline_s"))


def merged(spans: DataFrame) -> DataFrame:
    """lane, start_ns, end_ns of the union of each lane's intervals; touching ones merge.

    A span opens a new interval if it starts after all earlier ones of its lane have ended: the
    running maximum of ends within its part, and that of the parts before. Intervals are numbered
    within parts; what a part begins with may go on with the last interval of those before it.
    """
    by = ["lane"]
    rows = prefix.dealt(spans.select("lane", "start_ns", (F.col("start_ns") + F.col("dur_ns")).alias("end_ns")).where("start_ns is not null and end_ns is not null"), by, ["start_ns", "end_ns"])
    ends = rows.groupBy("lane", prefix.PART).agg(F.max("end_ns").alias("_end"))
    own = prefix.within(by, "start_ns", "end_ns")
    reach = F.greatest(F.max("end_ns").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    opened = prefix.with_summary(rows, ends.withColumn("_carried", F.max("_end").over(prefix.earlier(by))).drop("_end"), by)
    opened = opened.withColumn("_new", F.when(reach >= F.col("start_ns"), 0).otherwise(1))
    numbered = opened.withColumn("_island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy("lane", prefix.PART, "_island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    counts = pieces.groupBy("lane", prefix.PART).agg(F.max("_island").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(prefix.earlier(by)), F.lit(0))).drop("_n")
    told = prefix.with_summary(pieces, counts, by).withColumn("_island", F.col("_island") + F.col("_before"))
    return told.groupBy("lane", "_island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("_island")


def lane_utilization(spans: DataFrame) -> DataFrame:
    """lane, busy seconds (union, not sum) and their share of the timeline; empty if that is 0."""
    wall = timeline(spans).scalar()
    busy = merged(spans).groupBy("lane").agg((F.sum(F.col("end_ns") - F.col("start_ns")) / 1e9).alias("busy_s"))
    return busy.withColumn("wall", wall).where("wall > 0").select("lane", F.round("busy_s", 6).alias("busy_s"), F.round(F.col("busy_s") / F.col("wall"), 9).alias("utilization"))


def detailed(spans: DataFrame, level: int) -> DataFrame:
    return spans.where(F.col("detail") <= level)


def capped(spans: DataFrame, cap: int) -> DataFrame:
    """One row: how many of the spans the cap keeps and drops, and the last kept seq.

    The cap is on append order; seq need not be dense, so the cap-th smallest is looked up.
    """
    kept = spans.select("seq").orderBy("seq").limit(cap)
    ends = kept.agg(F.count("*").alias("kept"), F.max("seq").alias("last_seq"))
    return ends.withColumn("dropped", spans.agg(F.count("*")).scalar() - F.col("kept"))


def summary(spans: DataFrame, limit: int = 20) -> DataFrame:
    """The top stages by total seconds, each as a line of fixed widths."""
    top = aggregate(spans).orderBy(F.desc("total_s"), "name").limit(limit)
    line = F.format_string("%-34s %6d %10.3f %9.1f %9.1f %9.1f", "name", "n", "total_s", F.col("mean_s") * 1000, F.col("min_s") * 1000, F.col("max_s") * 1000)
    return top.select("name", "n", "total_s", line.alias("line"))


def report(spans: DataFrame, limit: int = 20, build: str = "release") -> DataFrame:
    """(n, line): the whole summary: its head, the top stages, how busy the lanes were, and a warning for builds whose times can't be compared."""
    head = spans.sparkSession.createDataFrame([(0, 0, f"{'stage':<34} {'count':>6} {'total s':>10} {'mean ms':>9} {'min ms':>9} {'max ms':>9}"), (1, 0, "\u2500" * 82)], "block int, at int, line string")
    top = summary(spans, limit)
    stages = top.select(F.lit(2).alias("block"), F.row_number().over(Window.orderBy(F.desc("total_s"), "name")).alias("at"), "line")  # limit rows at most
    lanes = lane_utilization(spans)
    busy = lanes.select(F.lit(5).alias("block"), F.row_number().over(Window.orderBy(F.desc("busy_s"), "lane")).alias("at"), F.format_string("  %-12s busy %8.3f s  (%4.1f%%)", "lane", "busy_s", F.col("utilization") * 100).alias("line"))
    some = lanes.limit(1)
    wall = timeline(spans).select(F.format_string("lane utilization over %.3f s wall:", "timeline_s").alias("line")).scalar()
    titles = some.select(F.lit(3).alias("block"), F.lit(0).alias("at"), F.lit("").alias("line")).unionAll(some.select(F.lit(4), F.lit(0), wall))
    out = head.unionAll(stages).unionAll(titles).unionAll(busy)
    if build != "release":
        warning = f"\u26a0\ufe0f {build.upper()} build: timings are NOT comparable"
        out = out.unionAll(spans.sparkSession.createDataFrame([(6, 0, ""), (7, 0, warning)], out.schema))
    # As many rows as stages and lanes: one order of them all.
    return out.select((F.row_number().over(Window.orderBy("block", "at")) - 1).alias("n"), "line")


def ndjson(spans: DataFrame) -> DataFrame:
    """seq and one JSON object per span, keys sorted, seconds rounded to 6 places."""
    start, dur = (F.round(F.col(c) / 1e9, 6) for c in ("start_ns", "dur_ns"))
    return spans.select("seq", F.to_json(F.struct("attrs", dur.alias("durS"), "lane", "name", start.alias("startS"), F.lit("span").alias("t"), "tid")).alias("line"))


def chrome_trace(spans: DataFrame) -> DataFrame:
    """Trace events: one M row per lane, numbered by first appearance, and one X row per span.

    Lanes are numbered over one row per lane; only that small table is joined back.
    """
    lanes = spans.groupBy("lane").agg(F.min("seq").alias("first_seq"))
    lanes = lanes.withColumn("tid", F.row_number().over(Window.orderBy("first_seq")))
    x = spans.drop("tid").join(lanes, "lane").select(
        F.lit("X").alias("ph"), "name", F.col("lane").alias("cat"), "tid",
        (F.col("start_ns") / 1000.0).alias("ts"), (F.col("dur_ns") / 1000.0).alias("dur"),
        F.when(F.size("attrs") > 0, F.to_json("attrs")).alias("args"),
    )
    m = lanes.select(F.lit("M").alias("ph"), F.lit("thread_name").alias("name"), F.lit(None).cast("string").alias("cat"), "tid", F.lit(None).cast("double").alias("ts"), F.lit(None).cast("double").alias("dur"), F.to_json(F.create_map(F.lit("name"), "lane")).alias("args"))
    return m.unionByName(x)

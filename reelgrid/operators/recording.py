"""Spans from a log of begin and end events, across switching and resetting of the collection.

The log has rows (kind, seq, t, handle, name, lane, detail, tid, attrs) in the order of (t, seq); kinds are
begin, end, event, enable (detail: the level), disable and reset. A span is recorded if the collection
was on, and its detail within the level, when it began; it is appended when it ends. Its duration is
absolute; its start is relative to the epoch at its end, and 0 where it began before that. enable and
reset begin a new epoch and drop what was collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def with_state(log: DataFrame) -> DataFrame:
    """log with on, level and epoch (the last row's that switched or reset, up to each row).

    As-of joins by prefix scans: one summary row a part carries the switches and epochs before it.
    """
    rows = prefix.dealt(log, [], ["t", "seq"])
    switch = F.when(F.col("kind").isin("enable", "disable"), F.struct("t", "seq", (F.col("kind") == "enable").alias("on"), F.col("detail").alias("level")))
    epoch = F.when(F.col("kind").isin("enable", "reset"), F.struct("t", "seq"))
    ends = rows.groupBy(prefix.PART).agg(F.max(switch).alias("_s"), F.max(epoch).alias("_e"))
    carried = ends.select(prefix.PART, F.max("_s").over(prefix.earlier([])).alias("_s"), F.max("_e").over(prefix.earlier([])).alias("_e"))
    upto = prefix.within([], "t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", F.last(switch, ignorenulls=True).over(upto).alias("_os"), F.last(epoch, ignorenulls=True).over(upto).alias("_oe"))
    told = prefix.with_summary(own, carried, [])
    s, e = F.coalesce("_os", "_s"), F.coalesce("_oe", "_e")
    return told.select(*log.columns, F.coalesce(s["on"], F.lit(False)).alias("on"), s["level"].alias("level"), e["t"].alias("epoch"), e["seq"].alias("_epoch_seq"))


def joined(attrs: Column, extra: Column) -> Column:
    """Attributes of a beginning with those of its end, which win."""
    extra = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(F.coalesce(attrs, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(extra), k)), extra)


def recorded(log: DataFrame) -> DataFrame:
    """Every span that was appended: name, lane, start_ns, dur_ns, tid, seq (of its end), detail, attrs, epoch, and whether it is still collected (kept)."""
    rows = with_state(log)
    taken = F.col("on") & (F.col("detail") <= F.col("level"))
    begins = rows.where((F.col("kind") == "begin") & taken).select("handle", "name", "lane", "detail", "tid", "attrs", F.struct("t", "seq").alias("_from"))
    ends = rows.where("kind = 'end'").select("handle", "epoch", "_epoch_seq", F.col("attrs").alias("_extra"), F.struct("t", "seq").alias("_to"))
    spans = begins.join(ends, "handle").where(F.col("_from") < F.col("_to")).select(
        "name", "lane", F.greatest(F.col("_from.t") - F.col("epoch"), F.lit(0)).alias("start_ns"), F.greatest(F.col("_to.t") - F.col("_from.t"), F.lit(0)).alias("dur_ns"),
        "tid", F.col("_to.seq").alias("seq"), "detail", joined(F.col("attrs"), F.col("_extra")).alias("attrs"), "epoch", "_epoch_seq",
    )
    marks = rows.where((F.col("kind") == "event") & taken).select("name", "lane", (F.col("t") - F.col("epoch")).alias("start_ns"), F.lit(0).cast("long").alias("dur_ns"), "tid", "seq", "detail", joined(F.col("attrs"), F.lit(None).cast("map<string,string>")).alias("attrs"), "epoch", "_epoch_seq")
    last = log.where(F.col("kind").isin("enable", "reset")).agg(F.max(F.struct("t", "seq")).alias("l")).select("l.seq").scalar()
    return spans.unionByName(marks).withColumn("kept", F.col("_epoch_seq").eqNullSafe(last)).drop("_epoch_seq")

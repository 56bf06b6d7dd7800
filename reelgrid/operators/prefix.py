"""Distributed prefix scans: what a row needs of the rows before it, without sorting a whole group in one task.

Rows are dealt out by ranges of (group, order) and written once, so that every reader sees the same
parts. A scan runs within each part, over (group, part) windows; one summary row for each group and
part carries what lies beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

PART = "_part"


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with the number of their part; parts ascend with (by, order)."""
    return checkpointed(rows.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()))


def within(by: list[str], *order: Column | str):
    """The window of a group's rows in one part."""
    return Window.partitionBy(*by, PART).orderBy(*order)


def earlier(by: list[str]):
    """For summary rows: the group's parts before this one."""
    return Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def later(by: list[str]):
    return Window.partitionBy(*by).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)


def with_summary(rows: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """rows joined with the summary of their group and part; null groups are groups."""
    keys = [*by, PART]
    told = summary.withColumnsRenamed({k: f"_s{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    return rows.join(told, same).drop(*[f"_s{i}" for i in range(len(keys))])


def order_statistics(counts: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """For each group, of the sorted values those at places (columns of `total`, from 0), from rows of value and n.

    counts: one row for each group and value, as merged() of states gives; null values don't count.
    """
    rows = dealt(counts.where(F.col(value).isNotNull()).select(*by, value, "n"), by, [value])
    sums = rows.groupBy(*by, PART).agg(F.sum("n").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier(by)), F.lit(0))).withColumn("total", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    upto = F.col("_before") + F.sum("n").over(within(by, value).rowsBetween(Window.unboundedPreceding, 0))
    placed = with_summary(rows, sums, by).withColumn("_upto", upto)
    picked = {name: F.max(F.when((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("n")), F.col(value))) for name, at in places.items()}
    return placed.groupBy(*by).agg(F.max("total").alias("total"), *[x.alias(name) for name, x in picked.items()])


def states(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The mergeable state of exact percentiles: how often each group has each value."""
    return rows.groupBy(*by, value).agg(F.count("*").alias("n"))


def merged(*of: DataFrame, by: list[str], value: str) -> DataFrame:
    """The state of all rows that the states stand for; no row is read again."""
    out = of[0]
    for x in of[1:]:
        out = out.unionByName(x)
    return out.groupBy(*by, value).agg(F.sum("n").alias("n"))

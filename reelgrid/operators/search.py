"""Searches over a knob whose score is an expression: folds over a fixed number of steps, one row per item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lowest_quality(items: DataFrame, score: Callable[[Column], Column], target: Column, lo: float = 0.1, hi: float = 1.0, iterations: int = 8) -> DataFrame:
    """The lowest knob in [lo, hi] that reaches the target by bisection; the top is measured first."""
    top = score(F.lit(hi))
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(hi).alias("best"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        met = score(mid) >= target
        return F.struct(F.when(met, s["lo"]).otherwise(mid).alias("lo"), F.when(met, mid).otherwise(s["hi"]).alias("hi"), F.when(met, mid).otherwise(s["best"]).alias("best"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step, lambda s: s["best"])
    return items.withColumn("met", top >= target).withColumn("quality", F.when(F.col("met"), found).otherwise(hi))


def bitrate(items: DataFrame, score: Callable[[Column], Column], target: Column, ceiling: Column, require_smaller: Column, iterations: int = 6, priors: bool = True, margin: float = 1.0) -> DataFrame:
    """Bisection of a bitrate under its ceiling, with bracket prior, convergence, slope abort and
    descent: adds best (null if no candidate clears), passes, stop, and descended."""
    epsilon = 0.05 if priors else 0.0
    none = F.lit(None).cast("double")
    first = ceiling * F.when(require_smaller & F.lit(priors), 0.35).otherwise(0.04)
    start = F.struct(first.alias("lo"), ceiling.cast("double").alias("hi"), none.alias("best"), none.alias("miss_b"), none.alias("miss_p"), F.lit(0).alias("passes"), F.lit("").alias("stop"))

    def step(may_abort: bool):
        def one(s: Column, _: Column) -> Column:
            done = s["stop"] != ""
            narrow = F.lit(epsilon > 0) & (s["hi"] - s["lo"] <= s["hi"] * epsilon)
            b = (s["lo"] + s["hi"]) / 2
            p = score(b)
            met = p >= target
            slope = F.when(b > s["miss_b"], F.greatest(F.lit(0.0), (p - s["miss_p"]) / ((b - s["miss_b"]) / 1e6))).otherwise(0.0)
            futile = F.lit(priors and may_abort) & ~met & s["best"].isNull() & s["miss_b"].isNotNull() & (p + slope * ((s["hi"] - b) / 1e6) < target - margin)
            moved = F.struct(
                F.when(met, s["lo"]).otherwise(b).alias("lo"),
                F.when(met, b).otherwise(s["hi"]).alias("hi"),
                F.when(met, b).otherwise(s["best"]).alias("best"),
                F.when(met, s["miss_b"]).otherwise(b).alias("miss_b"),
                F.when(met, s["miss_p"]).otherwise(p).alias("miss_p"),
                (s["passes"] + 1).alias("passes"),
                F.when(futile, "abort").otherwise("").alias("stop"),
            )
            stopped = s.withField("stop", F.lit("converged"))
            return F.when(done, s).when(narrow, stopped).otherwise(moved)

        return one

    turns = F.sequence(F.lit(1), F.lit(iterations))
    rows = items.withColumn("s", F.aggregate(turns, start, step(True)))
    down = F.col("s.best").isNotNull() & (F.col("s.lo") == first)
    again = F.struct((F.col("s.best") * 0.02).alias("lo"), F.col("s.best").alias("hi"), F.col("s.best").alias("best"), none.alias("miss_b"), none.alias("miss_p"), F.col("s.passes").alias("passes"), F.lit("").alias("stop"))
    rows = rows.withColumn("descended", down).withColumn("d", F.when(down, F.aggregate(turns, again, step(False))).otherwise(F.col("s")))
    return rows.select("*", F.col("d.best").alias("best"), F.col("d.passes").alias("passes"), F.when(F.col("s.stop") == "", "exhausted").otherwise(F.col("s.stop")).alias("stop")).drop("s", "d")


def with_ceiling(found: DataFrame, score: Callable[[Column], Column], target: Column, ceiling: Column) -> DataFrame:
    """rate and met of rows from bitrate(): where no candidate clears, the ceiling is taken, and it wins if it clears itself."""
    return found.select("*", F.coalesce("best", ceiling).alias("rate"), (F.col("best").isNotNull() | (score(ceiling) >= target)).alias("met"))


def squeezed(found: DataFrame, score: Callable[[Column], Column], emitted: Callable[[Column], Column], target: Column, corridor: Column, steps: int = 3, share: float = 0.92) -> DataFrame:
    """Rows of bitrate() with squeezed (rate) and squeezes: below a winner's emitted rate the corridor is tried, at most steps times.

    score(rate) and emitted(rate) are what a candidate of the corridor scores and emits. A candidate is
    taken if it clears the target and emits strictly less; the first that doesn't ends the search. Where
    there is no winner, or no corridor (a least quantiser), nothing is tried.
    """
    begin = F.struct(F.col("best").alias("rate"), F.col("emitted").alias("emitted"), F.lit(0).alias("taken"), (F.col("best").isNull() | corridor.isNull() | ~(F.col("emitted") > 0)).alias("over"))

    def step(s: Column, _: Column) -> Column:
        rate = s["emitted"] * share
        better = (score(rate) >= target) & (emitted(rate) < s["emitted"])
        taken = F.struct(rate.alias("rate"), emitted(rate).alias("emitted"), (s["taken"] + 1).alias("taken"), F.lit(False).alias("over"))
        return F.when(s["over"], s).when(F.coalesce(better, F.lit(False)), taken).otherwise(s.withField("over", F.lit(True)))

    rows = found.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step))
    return rows.select(*found.columns, F.col("_s.rate").alias("squeezed"), F.col("_s.taken").alias("squeezes")).drop("_s")


def progress(done: Column, sub: Column, planned: Column) -> Column:
    return F.least(F.lit(0.92), 0.10 + 0.82 * (done + sub) / F.greatest(planned, done + 1))


def scoring_backend(explicit: Column, has_closure: Column) -> Column:
    return F.coalesce(explicit, F.when(has_closure, "gpu").otherwise("cpu"))

"""Relational kernels against the same in numpy, on planes of lineitem and made ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.functions import kernels
from reelgrid.operators import planes
from reelgrid.plans import catalogue


@pytest.fixture(scope="module")
def whole(spark, sf):
    """The whole planes of lineitem, as arrays (the last one lacks samples)."""
    rows = catalogue._plane64(spark, sf).collect()
    out = {}
    for r in rows:
        a, b = out.setdefault(r["id"], (np.full((64, 64), np.nan), np.full((64, 64), np.nan)))
        a[r["y"], r["x"]], b[r["y"], r["x"]] = r["v"], r["d"]
    return {k: p for k, p in out.items() if not np.isnan(p[0]).any()}


def test_similarity(spark, sf, whole):
    got = {r["id"]: r for r in catalogue.QUERIES["ssim_map"](spark, sf).collect()}
    assert whole and set(whole) <= set(got)
    for k, (a, b) in whole.items():
        m = kernels.ssim_map(a, b)
        assert got[k]["ssim"] == pytest.approx(m.mean(), abs=2e-6) and got[k]["worst"] == pytest.approx(m.min(), abs=2e-6) and got[k]["n"] == m.size


def test_octaves(spark, sf, whole):
    got = {(r["id"], k): r[n] for r in catalogue.QUERIES["per_octave_ssim"](spark, sf).collect() for k, n in enumerate(("base", "band_1", "band_2"))}
    for k, (a, b) in whole.items():
        bands, base = kernels.octave_ssim(a, b)
        assert len(bands) == 2 and got[k, 0] == pytest.approx(base, abs=1e-4)
        for i, band in enumerate(bands, 1):
            assert got[k, i] == pytest.approx(band, abs=1e-4)


def test_consistency(spark, sf, whole):
    got = {r["id"]: r for r in catalogue.QUERIES["downsample_consistency"](spark, sf).collect()}
    for k, (a, b) in whole.items():
        p, s = kernels.downsample_consistency(kernels.half(a), b)
        assert got[k]["psnr"] == pytest.approx(p, abs=1e-4) and got[k]["ssim"] == pytest.approx(s, abs=1e-4) and got[k]["worst"] <= got[k]["ssim"]


def test_identical_planes_and_too_small(spark):
    p = spark.range(400).select(F.lit(1).alias("id"), (F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.rand(1).alias("a")).cache()
    assert planes.ssim(p.withColumn("b", F.col("a")), 20, 20).agg(F.min("v"), F.count("*")).first() == (pytest.approx(1.0), 100)
    with pytest.raises(ValueError):
        planes.ssim(p.withColumn("b", F.col("a")), 10, 20)


def test_channels_share_one_agreement(spark):
    rows = [(1, 0, 0, 0.0, 1.0), (1, 0, 1, 0.5, 0.5), (1, 1, 0, 0.2, 0.2)]
    was = [(1, 0, 0, 0.2, 1.0), (1, 0, 1, None, None)]
    fresh, moved = (spark.createDataFrame(x, "id int, y int, x int, r double, g double") for x in (rows, was))
    out = {(r["y"], r["x"]): (r["r"], r["g"]) for r in planes.channel_blended(fresh, moved, 0.5, 0.4, ("r", "g")).collect()}
    assert out[0, 0] == (pytest.approx(0.375 * 0.2), pytest.approx(1.0)) and out[0, 1] == (0.5, 0.5) and out[1, 0] == (0.2, 0.2)
    full = planes.channel_blended(fresh, moved, 0.5, 0.0, ("r", "g")).where("x = 0 and y = 0").first()
    assert full["r"] == pytest.approx(0.1)  # no tolerance: full agreement


@pytest.mark.parametrize("name", ["ssim_map", "per_octave_ssim", "downsample_consistency"])
def test_samples_are_moved_once(spark, sf, name):
    """Whole planes are in one part from the first shuffle on: no sum along an axis and no join moves their samples."""
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if " Exchange hashpartitioning" in x and "_part" not in x]
    assert moved and all("REPARTITION_BY_NUM" in x or ("y#" not in x and "x#" not in x) for x in moved)


def test_smoothed_difference_equals_two_steps(spark):
    """One step to half an axis and back, of odd and even sizes, against the two steps."""
    for n, m in ((9, 6), (12, 7)):
        p = spark.range(n * m).select(F.lit(1).alias("id"), (F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), F.rand(1).alias("a"), F.rand(2).alias("b")).cache()
        back = planes.expanded(planes.downscaled(p, n, m, ("a", "b")), -(-n // 2), -(-m // 2), n, m, ("a", "b"))
        want = {(r["y"], r["x"]): (r["a"], r["b"]) for r in back.collect()}
        was = {(r["y"], r["x"]): (r["a"], r["b"]) for r in p.collect()}
        got = planes.laplacian(p, n, m).collect()
        assert len(got) == n * m
        for r in got:
            k = r["y"], r["x"]
            assert (r["a"], r["b"]) == (pytest.approx(was[k][0] - want[k][0], abs=1e-12), pytest.approx(was[k][1] - want[k][1], abs=1e-12))


@pytest.mark.parametrize("name", ["ssim_map", "per_octave_ssim", "downsample_consistency"])
def test_places_and_quantities_are_moved(spark, sf, name):
    """The shuffle that brings planes together moves two columns; coordinates and both planes are made after it."""
    lines = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    sides = [x for i, y in enumerate(lines) if "REPARTITION_BY_NUM" in y for x in lines[i + 2 : i + 4] if "Project [" in x]
    assert sides and all(x.count(" AS ") == 2 for x in sides)

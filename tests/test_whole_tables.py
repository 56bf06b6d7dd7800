"""Queries that once read a part only: places in the order of all rows, whole planes, all chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.functions import kernels
from reelgrid.operators import sampling
from reelgrid.plans import catalogue


def test_numbered_equals_sorting(spark):
    rng = np.random.default_rng(3)
    data = [(None if g == 0 else int(g), int(p), i) for i, (g, p) in enumerate(zip(rng.choice(4, 3000, p=[0.1, 0.7, 0.1, 0.1]), rng.integers(0, 200, 3000)))]
    rows = spark.createDataFrame(data, "track int, pts int, tie int").repartition(5)
    got = sampling.numbered(rows, ["track"], ["pts", "tie"], "place").collect()
    want = []
    for g in {d[0] for d in data}:
        want += [(*d, i) for i, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1:]))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    alone = sampling.numbered(rows, [], ["pts", "tie"], "place").collect()
    assert [r["place"] for r in sorted(alone, key=lambda r: (r["pts"], r["tie"]))] == list(range(3000))


def test_numbered_empty(spark):
    assert sampling.numbered(spark.createDataFrame([], "track int, pts int, tie int"), ["track"], ["pts", "tie"], "place").isEmpty()


@pytest.fixture(scope="module")
def planes(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").select(F.col("l_quantity").cast("double")).toPandas().iloc[:, 0].to_numpy()
    n = -(-len(rows) // 4096)

    def whole(v):
        return np.pad(v, (0, n * 4096 - len(v))).astype(np.float32).reshape(n, 64, 64)

    return whole(rows / 50), whole(np.floor(rows / 5) / 10)


@pytest.mark.parametrize(
    "name,column,f,digits",
    [
        ("ssim_map", "ssim", lambda a, b: kernels.ssim_map(a, b).mean(), 6),
        ("per_octave_ssim", "base", lambda a, b: kernels.octave_ssim(a, b)[1], 6),
        ("downsample_consistency", "psnr", lambda a, b: kernels.downsample_consistency(kernels.half(a), b)[0], 6),
    ],
)
def test_all_planes_are_scored(spark, sf, planes, name, column, f, digits):
    got = {r["id"]: r[column] for r in catalogue.QUERIES[name](spark, sf).collect()}
    assert sorted(got) == list(range(len(planes[0])))
    for i, (a, b) in enumerate(zip(*planes)):
        assert got[i] == pytest.approx(float(f(a, b)), abs=2 * 10**-digits)


def test_ssimulacra2_scores_all_planes(spark, sf, planes):
    assert sorted(r["id"] for r in catalogue.QUERIES["ssimulacra2"](spark, sf).collect()) == list(range(len(planes[0])))

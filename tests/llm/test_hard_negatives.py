"""Hard negatives against all products, and against the SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from reelgrid.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, n=10):
    good = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, label, v) in enumerate(good):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, lab == label) for j, (b, lab, w) in enumerate(good) if j != at and len(w) == len(v)]
        for p, positive, _ in sorted(x for x in scored if x[2])[:k]:
            fits = sorted(x for x in scored if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p)[:n]
            out += [(a, positive, r, b, -p, -s) for r, (s, b, _) in enumerate(fits, 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(n, d, seed, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(10, d))
    label = r.integers(0, 10, n)
    return [(i, ((centres[label[i]] + r.normal(size=d)) * scale).tolist(), int(label[i])) for i in range(n)]


def test_table_and_sql(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = told(H.mined(spark.read.parquet(f"{sf}/embeddings.parquet")))
    assert got == brute(rows) and got
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        assert sorted(db.execute(H.ORACLE).fetchall()) == got


@pytest.mark.parametrize("d", [1, 3, 40])
def test_small_blocks_of_any_dimension(spark, d):
    """Cells of a few rows, vectors of all signs, and copies in every block."""
    rows = clustered(400, d, d) + [(400 + i, [0.5] * d, i % 3) for i in range(60)]
    assert told(H.mined(spark.createDataFrame(rows, ROWS), every=20, anchor_bytes=64 * d, candidate_bytes=8 * 50 * d)) == [x for x in brute_every(rows, 20)]


def brute_every(rows, every):
    """brute() with other anchors: ids are scaled so that they are divisible by 100."""
    good = [(i, v, lab) for i, v, lab in rows]
    out = []
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, lab in good]
    for at, (a, label, v) in enumerate(whole):
        if a % every:
            continue
        scored = [(-int(v @ w), b, lab == label) for j, (b, lab, w) in enumerate(whole) if j != at]
        for p, positive, _ in sorted(x for x in scored if x[2])[:5]:
            fits = sorted(x for x in scored if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(a, positive, r, b, -p, -s) for r, (s, b, _) in enumerate(fits, 1)]
    return sorted(out)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = clustered(150, 4, 1) + [(200, [1.0, 1.0, None, 1.0], 1), (201, [1.0, nan, 1.0, 1.0], 1), (202, [inf, 1.0, 1.0, 1.0], 1), (203, None, 1), (204, [1.0] * 4, None), (None, [1.0] * 4, 2), (300, [1.0, 2.0], 3), (301, [1.0, 2.0], 3), (302, [0.7, 1.4], 4), (400, [], 1), (401, [], 1), (402, [], 2), (500, [0.0] * 4, 5), (501, [-1.0] * 4, 5)]
    odd = spark.createDataFrame([(*r, "x", 1.0) for r in rows], ROWS + ", file string, v double")
    assert told(H.mined(odd)) == brute(rows)
    assert told(H.mined(spark.createDataFrame([], ROWS))) == []


def test_repeated_rows(spark):
    rows = clustered(120, 6, 2)
    rows += rows[:30] + [rows[0]] * 3
    got = told(H.mined(spark.createDataFrame(rows, ROWS)))
    assert got == brute(rows)


def test_large_numbers_are_exact_or_an_error(spark):
    rows = clustered(150, 4, 3, 1e6)
    assert told(H.mined(spark.createDataFrame(rows, ROWS))) == brute(rows)
    with pytest.raises(Exception, match="64 bits|Overflow|too large|too big"):
        H.mined(spark.createDataFrame(clustered(150, 4, 3, 1e14), ROWS)).collect()


def test_bounds_keep_every_pair_that_counts():
    r = np.random.default_rng(0)
    x = np.floor(256 * r.normal(size=(300, 48)) * np.geomspace(1, 0.01, 48)).astype(np.int64)
    axes = H.basis((x.T @ x).astype(np.float64))
    a = H.Side(x, axes)
    seen = []

    def judge(rows, lower, upper):
        seen.append((rows, lower, upper))
        return np.ones(len(rows), bool)

    p, q = H.tile_pairs(a, a, slice(0, 300), slice(0, 300), np.ones((300, 300), bool), judge)
    true = (x @ x.T)[p, q]
    assert len(seen) == 4 and all(((lower <= true) & (true <= upper)).all() for _, lower, upper in seen)
    assert np.mean(seen[0][2] - seen[0][1]) > np.mean(seen[2][2] - seen[2][1])

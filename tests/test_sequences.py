"""Folds that stream, prefix scans and as-of joins: long clips, single lanes, odd options, streams against batches."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import folds, prefix, sampling, segment, spans
from reelgrid.streaming import stateful

DELTAS = "clip long, idx long, score double"


def rule(deltas, k=2.0, floor=0.01, window=48, history=12, gap=6, mad=False):
    """The detector's rule, written with whole lists."""
    held, since, cuts = [], 1 << 40, []
    for i, d in enumerate(deltas):
        if len(held) < history:
            held.append(d)
            since += 1
            continue
        s = sorted(held)
        middle = s[len(s) // 2]
        if mad:
            t = middle + k * max(sorted(abs(x - middle) for x in s)[len(s) // 2], floor)
        else:
            p90 = s[round(0.9 * (len(s) - 1) + 1e-9)]
            t = p90 + k * max(p90 - middle, floor)
        if d > t and since >= gap:
            cuts.append(i)
            since = 0
        else:
            since += 1
            held.append(min(d, t))
            if len(held) > window:
                held.pop(0)
    return cuts


@pytest.mark.parametrize("mad", [False, True])
@pytest.mark.parametrize(("window", "history"), [(48, 12), (4, 12), (4, 2), (12, 12), (100, 30)])
def test_detector_is_the_rule(window, history, mad):
    r = np.random.default_rng(window + history)
    deltas = (r.gamma(1, 1, 600) + 20 * (r.random(600) < 0.05)).round(2).tolist()
    d = folds.CutDetector(k=1.5, size=window, history=history, mad=mad)
    assert [i for i, v in enumerate(deltas) if d.next(v)] == rule(deltas, 1.5, window=window, history=history, mad=mad)


def test_window_smaller_than_history_fires(spark):
    """A flat clip with one spike at 40."""
    rows = [(1, i, 9.0 if i == 40 else 1.0) for i in range(80)]
    got = segment.causal_cuts(spark.createDataFrame(rows, DELTAS), window=4, history=12).collect()
    assert [tuple(x) for x in got] == [(1, 40)]


def test_a_million_frames_of_one_clip(spark):
    """Linear time, and nothing of the clip's size in a task: the window is all that is carried."""

    def timed(n):
        clip = spark.range(n).select(F.lit(1).cast("long").alias("clip"), F.col("id").alias("idx"), F.when(F.col("id") % 1000 == 999, 50.0).otherwise((F.col("id") * 7919 % 101) / 100.0).alias("score"))
        began = time.time()
        return segment.causal_cuts(clip).count(), segment.shots(clip, 10.0).count(), segment.blended(clip, 0.6, 1.0).count(), time.time() - began

    timed(1000)
    few, many = timed(100_000), timed(1_000_000)
    assert many[:3] == (1000, 1001, 1_000_000) and few[0] == 100
    assert many[3] < 25 * few[3] + 5


def test_nulls_several_clips_and_no_rows(spark):
    rows = [(None, i, float(i == 20) * 9) for i in range(30)] + [(5, i, float(i == 25) * 9) for i in range(30)]
    deltas = spark.createDataFrame(rows, DELTAS)
    assert sorted((x["clip"] or 0, x["idx"]) for x in segment.causal_cuts(deltas).collect()) == [(0, 20), (5, 25)]
    empty = spark.createDataFrame([], DELTAS)
    assert segment.causal_cuts(empty).isEmpty() and segment.two_pass_cuts(empty).isEmpty() and segment.blended(empty, 0.5, 1.0).isEmpty()
    two = spark.createDataFrame([(1, 0, 1.0), (1, 1, 9.0)], DELTAS)
    assert segment.two_pass_cuts(two).isEmpty()


def test_stream_of_stabilisers_equals_batch(spark, tmp_path):
    """Many micro-batches; at each cut the blend starts anew."""
    r = np.random.default_rng(3)
    rows = []
    for clip in range(3):
        level = 0.0
        for i in range(160):
            level += 40 * (r.random() < 0.05)
            rows.append((clip, i, float(level + r.normal())))
    for k in range(8):
        spark.createDataFrame([x for x in rows if x[1] // 20 == k], DELTAS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    before = spark.conf.get(stateful.ROCKSDB[0], None)
    spark.conf.set(*stateful.ROCKSDB)
    try:
        stream = spark.readStream.schema(DELTAS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = stateful.shot_blended(stream, 0.6, 5.0, k=2.0).writeStream.format("memory").queryName("shots").option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        assert q.lastProgress["batchId"] >= 7
        q.stop()
    finally:
        spark.conf.unset(stateful.ROCKSDB[0]) if before is None else spark.conf.set(stateful.ROCKSDB[0], before)
    want = sorted(tuple(x) for x in segment.shot_blended(spark.createDataFrame(rows, DELTAS), 0.6, 5.0, k=2.0).collect())
    assert sorted(tuple(x) for x in spark.sql("SELECT * FROM shots").collect()) == want
    cuts = [(c, i) for c, i, cut, _ in want if cut]
    values = {(c, i): v for c, i, v in rows}
    assert len(cuts) > 5 and all(v == values[c, i] for c, i, cut, v in want if cut)


def test_reorder_stream_drops_nothing(spark, tmp_path):
    """Packets displaced by up to 32 places, and some later than that, over several micro-batches."""
    r = random.Random(1)
    packets = []
    for track in (1, 2):
        order = sorted(range(200), key=lambda p: p + r.random() * 25)
        packets += [(track, arrival, p * 10) for arrival, p in enumerate(order)]
    packets += [(2, 200, 5)]
    for k in range(6):
        spark.createDataFrame([x for x in packets if x[1] // 40 == k], "track long, arrival long, pts long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("track long, arrival long, pts long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stateful.reordered(stream).writeStream.format("memory").queryName("packets").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(x) for x in spark.sql("SELECT track, place, pts FROM packets").collect())
    for track in (1, 2):
        own = [p for t, _, p in got if t == track]
        rows = [(p,) for t, _, p in packets if t == track]
        out, held = stateful.reorder(rows, [])
        assert own == [p for (p,) in out] and len(out) + len(held) == len(rows)
        assert [p for p in own if p != 5] == sorted(p for p in own if p != 5)
    assert 5 in [p for t, _, p in got if t == 2]


# ---- prefix scans

SPANS = "lane string, start_ns long, dur_ns long"


def union(rows):
    out = []
    for a, b in sorted((s, s + d) for _, s, d in rows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_union_over_many_parts(spark):
    r = random.Random(2)
    rows = [("one", r.randrange(10**6), r.randrange(1, 400)) for _ in range(3000)] + [("one", 100_000, 500_000), ("two", 5, 0), ("two", 5, 0), ("two", 6, 1)]
    got = spans.merged(spark.createDataFrame(rows, SPANS)).collect()
    for lane in ("one", "two"):
        assert sorted((x["start_ns"], x["end_ns"]) for x in got if x["lane"] == lane) == union([x for x in rows if x[0] == lane])


def test_a_single_lane_of_disjoint_spans_takes_many_tasks(spark, request):
    lane = spark.range(200_000).select(F.lit("only").alias("lane"), (F.col("id") * 10).alias("start_ns"), F.lit(5).cast("long").alias("dur_ns"))
    assert spans.merged(lane).count() == 200_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts are put together otherwise
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert spans.merged(lane).count() == 200_000
    parts = prefix.dealt(lane, ["lane"], ["start_ns"]).groupBy(prefix.PART).count().collect()
    assert len(parts) >= 6 and max(x["count"] for x in parts) < 60_000


def test_asof_of_a_million_stamps_within_one_tolerance(spark):
    """All frames lie within the tolerance of each other: two candidates a reference are built, not all pairs."""
    stamps = spark.range(1_000_000)
    reference = stamps.where("id % 2 = 0").select(F.col("id").alias("ref_id"), F.col("id").alias("pts"), F.lit(1).alias("clip"))
    other = stamps.where("id % 2 = 1").select(F.col("id").alias("other_id"), F.col("id").alias("pts"), F.lit(1).alias("clip"))
    got = sampling.nearest(reference, other, 10**9, ["clip"]).agg(F.count("*"), F.sum((F.col("other_id") == F.col("ref_id") + 1).cast("int"))).first()
    assert tuple(got) == (500_000, 500_000)


@pytest.mark.parametrize("tolerance", [0, 3, 10**6])
def test_asof_against_brute_force(spark, tolerance):
    r = random.Random(tolerance)
    ref = [(i, r.choice([1, 2, None]), r.choice([None, *range(60)])) for i in range(150)]
    oth = [(i, r.choice([1, 2, 3, None]), r.choice([None, *range(60)])) for i in range(80)]
    got = sampling.nearest(spark.createDataFrame(ref, "ref_id long, clip int, pts long"), spark.createDataFrame(oth, "other_id long, clip int, pts long"), tolerance, ["clip"])
    want = []
    for i, clip, p in ref:
        near = [(abs(q - p), -q, -j) for j, k, q in oth if p is not None and q is not None and k == clip and abs(q - p) <= tolerance]
        if near:
            _, q, j = min(near)
            want.append((clip or 0, i, p, -j, -q))
    assert sorted((x[0] or 0, *x[1:]) for x in got.collect()) == sorted(want)


def test_order_statistics_of_merged_states(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", None]), r.choice([None, 1, 2, 3, 3, 3, r.randrange(10**6)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v long")
    halves = [prefix.states(df.where(F.col("v").isNull() | (F.col("v") % 2 == i)), ["k"], "v") for i in range(2)]
    state = prefix.merged(*halves, by=["k"], value="v")
    got = {x["k"]: tuple(x)[1:] for x in prefix.order_statistics(state, ["k"], "v", {"low": F.lit(0), "p": F.floor((F.col("total") - 1) * 0.37), "high": F.col("total") - 1}).collect()}
    for k in ("a", None):
        v = sorted(v for q, v in rows if q == k and v is not None)
        assert got[k] == (len(v), v[0], v[int((len(v) - 1) * 0.37)], v[-1])

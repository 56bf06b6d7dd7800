"""Invariants of the dense kernels, hand-made containers, folds and streams against plain Python."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.functions import binwalk, kernels
from reelgrid.operators import folds, policy, segment, spans
from reelgrid.sources import seams
from reelgrid.streaming import stateful

RNG = np.random.default_rng(4)
IMAGE = RNG.integers(0, 256, (64, 48, 3)).astype(np.uint8)
PLANE = RNG.random((48, 64)).astype(np.float32)


def test_equal_images_score_100():
    assert kernels.ssimulacra2(IMAGE, IMAGE) == 100.0
    assert kernels.psnr(PLANE, PLANE) == float("inf")
    assert kernels.ssim_map(PLANE, PLANE).mean() == pytest.approx(1, abs=1e-5)
    bands, base = kernels.octave_ssim(PLANE, PLANE)
    assert bands == pytest.approx([1] * len(bands), abs=1e-4) and base == pytest.approx(1, abs=1e-4) and len(bands) == 2


def test_more_noise_scores_less():
    noisy = [np.clip(IMAGE.astype(int) + RNG.normal(0, s, IMAGE.shape), 0, 255).astype(np.uint8) for s in (2, 10, 40)]
    scores = [kernels.ssimulacra2(IMAGE, x) for x in noisy]
    assert scores == sorted(scores, reverse=True) and scores[0] < 100


def test_sizes():
    with pytest.raises(ValueError):
        kernels.ssimulacra2(IMAGE[:7], IMAGE[:7])
    with pytest.raises(ValueError):
        kernels.ssim_map(PLANE[:10], PLANE[:10])
    with pytest.raises(ValueError):
        kernels.downsample_consistency(PLANE, PLANE[:20])
    assert kernels.half(PLANE[:47, :63]).shape == (24, 32)


def test_constants_survive():
    flat = np.full((40, 30), 0.25, np.float32)
    for out in (kernels.blur(flat, kernels.kernel(1.5, 6)), kernels.half(flat), kernels.resampled(flat, 17, 13), kernels.resampled(flat, 77, 50, True)):
        assert out == pytest.approx(np.full(out.shape, 0.25), abs=1e-6)


def test_warp_and_blend():
    out, valid = kernels.warp(PLANE, np.dstack([np.full(PLANE.shape, 1.0), np.zeros(PLANE.shape)]))
    assert out[:, :-1] == pytest.approx(PLANE[:, 1:]) and not valid[:, -1].any() and valid[:, :-1].all()
    assert kernels.blend(PLANE, PLANE, valid, 0.5, 0.1) == pytest.approx(PLANE)
    half = kernels.blend(np.zeros((2, 2)), np.ones((2, 2)), np.ones((2, 2), bool), 0.5, 0.0)
    assert half == pytest.approx(np.full((2, 2), 0.5))  # no tolerance: full agreement
    s = kernels.Stabiliser(0.5, 10.0)
    first = s.next(np.zeros((4, 4)))
    assert (first == 0).all() and s.next(np.ones((4, 4))).mean() == pytest.approx(0.5 * 0.9 * 0 + (1 - 0.5 * 0.9) * 1)
    assert (s.next(np.ones((5, 4))) == 1).all()
    assert kernels.scaled_flow(np.ones((4, 4, 2)), 8, 12)[..., 0] == pytest.approx(np.full((8, 12), 3.0))


def test_configuration_records():
    avc = bytes([1, 0x64, 0, 31, 0xFF, 0xE1]) + b"\0\x03abc" + bytes([1]) + b"\0\x02de"
    assert binwalk.nal_length_size(avc, False) == 4 and binwalk.parameter_sets(avc, False) == [b"abc", b"de"]
    with pytest.raises(ValueError):
        binwalk.parameter_sets(avc[:-1], False)
    with pytest.raises(ValueError):
        binwalk.nal_length_size(b"\1", True)


def test_seams():
    class One:
        decodes_alpha = False

        def __init__(self, codec):
            self.codec = codec

        def can_decode(self, codec):
            return codec == self.codec

    seams.decoders.clear()
    with pytest.raises(seams.Deferred):
        seams.decoder_for("V_VP9")
    a, b = One("V_VP9"), One("V_VP9")
    seams.decoders.register(a)
    seams.decoders.register(b)
    assert seams.decoder_for("V_VP9") is b
    with pytest.raises(ValueError):
        seams.decoder_for("V_VP9", alpha=True)
    seams.decoders.clear()


@pytest.mark.parametrize("mad", [False, True])
def test_causal_fold_equals_loop(spark, mad):
    rows = [(clip, i, float(v)) for clip in range(4) for i, v in enumerate(RNG.gamma(1, 1, 160) + 20 * (RNG.random(160) < 0.05))]
    deltas = spark.createDataFrame(rows, "clip long, idx long, score double")
    got = sorted(tuple(r) for r in segment.causal_cuts(deltas, 1.5, "mad" if mad else "tail").collect())
    want = []
    for clip in range(4):
        d = folds.CutDetector(k=1.5, mad=mad)
        want += [(clip, i) for c, i, v in rows if c == clip and d.next(v)]
    assert got == want and want


def test_cut_stream_equals_batch(spark, tmp_path):
    rows = [(clip, i, float(v)) for clip in range(3) for i, v in enumerate(RNG.gamma(1, 1, 120) + 20 * (RNG.random(120) < 0.06))]
    schema = "clip long, idx long, score double"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 40 == k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stateful.causal_cuts(stream, k=1.5).writeStream.format("memory").queryName("cuts").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(tuple(r) for r in segment.causal_cuts(spark.createDataFrame(rows, schema), 1.5).collect())
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM cuts").collect()) == want


def test_reorder_buffer():
    out, held = stateful.reorder([(p,) for p in (5, 1, 4, 2, 3)], [], depth=2)
    assert [p for (p,) in out] == [1, 2, 3] and held == [(4,), (5,)]
    late, held = stateful.reorder([(0,)], held, depth=2)
    assert late == [(0,)]  # late rows are not dropped


def test_span_edges(spark):
    schema = "name string, lane string, start_ns long, dur_ns long, tid long, seq long, detail long, attrs map<string,string>"
    empty = spark.createDataFrame([], schema)
    assert spans.timeline(empty).first()[0] == 0 and spans.lane_utilization(empty).collect() == []
    s = spark.createDataFrame([("a", "x", 0, 10, 1, 2, 0, {}), ("a", "y", 10, 5, 1, 1, 0, {}), ("b", "x", 10, 10, 1, 3, 0, {}), ("b", "x", 30, 10, 1, 4, 0, {})], schema)
    assert sorted(tuple(r) for r in spans.merged(s).collect()) == [("x", 0, 20), ("x", 30, 40), ("y", 10, 15)]
    assert {r["name"]: r["lane"] for r in spans.aggregate(s).collect()}["a"] == "y"


def test_policy_edges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(policy.enhance_class(F.lit(750), F.lit(600), F.lit(0.09))) == "clean"
    assert value(policy.enhance_class(F.lit(749), F.lit(600), F.lit(0.0899))) == "mixed"
    assert value(policy.is_hdr(F.lit(None).cast("string"))) is False
    w, h = policy.resolution_class(F.lit(2160), F.lit(3840), 1080)
    assert (value(w), value(h)) == (1080, 1920)
    assert value(policy.gif_delay(F.lit(0.010), F.lit(None).cast("double"))) == 0.1 and value(policy.still_delay(F.lit(0.010), F.lit(None).cast("double"))) == 0.010

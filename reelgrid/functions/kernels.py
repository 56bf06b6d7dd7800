"""Perceptual kernels on dense planes, in numpy, and Arrow functions over binary columns of planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

C1, C2 = 0.0001, 0.0009
RADIUS = 5

# Pooled-statistic weights of the published metric, by channel, scale and (L1, L4) x (ssim, artifact, detail).
WEIGHTS = [
    0.0, 0.0007376606707406586, 0.0, 0.0, 0.0007793481682867309, 0.0,
    0.0, 0.0004371155730107379, 0.0, 1.1041726426657346, 0.00066284834129271, 0.00015231632783718752,
    0.0, 0.0016406437456599754, 0.0, 1.8422455520539298, 11.441172603757666, 0.0,
    0.0007989109436015163, 0.000176816438078653, 0.0, 1.8787594979546387, 10.94906990605142, 0.0,
    0.0007289346991508072, 0.9677937080626833, 0.0, 0.00014003424285435884, 0.9981766977854967, 0.0003194975593443505,
    0.0004550992113792063, 0.0, 0.0, 0.0013648766163243398, 0.0, 0.0,
    0.0, 0.0, 0.0, 7.466890328078848, 0.0, 17.445833984131262,
    0.0006235601634041466, 0.0, 0.0, 6.683678146179332, 0.0003772440797961129, 1.027889937768264,
    225.20515300849274, 0.0, 0.0, 19.213238186143016, 0.0011401524586618361, 0.001237755635509985,
    176.39317598450694, 0.0, 0.0, 24.43300999870476, 0.28520802612117757, 0.0004485436923833408,
    0.0, 0.0, 0.0, 34.77906344483772, 44.835625328877896, 0.0,
    0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0008680556573291698, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0005313191874358747, 0.0, 0.00016533814161379112, 0.0, 0.0,
    0.0, 0.0, 0.0, 0.0004179171803251336, 0.0017290828234722833, 0.0,
    0.0020827005846636437, 0.0, 0.0, 8.826982764996862, 23.19243343998926, 0.0,
    95.1080498811086, 0.9863978034400682, 0.9834382792465353, 0.0012286405048278493, 171.2667255897307, 0.9807858872435379,
    0.0, 0.0, 0.0, 0.0005130064588990679, 0.0, 0.00010854057858411537,
]
assert len(WEIGHTS) == 108


def kernel(sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-np.square(np.arange(-radius, radius + 1, dtype=np.float32)) / np.float32(2 * sigma * sigma))
    return (k / k.sum(dtype=np.float32)).astype(np.float32)


def blur(plane: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Separable filter; beyond the edge, the edge counts."""
    r = len(k) // 2
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        plane = np.lib.stride_tricks.sliding_window_view(np.pad(plane, pad, mode="edge"), len(k), axis=axis) @ k
    return plane


def half(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape[:2]
    p = np.pad(plane, [(0, h % 2), (0, w % 2), *[(0, 0)] * (plane.ndim - 2)], mode="edge")
    return (p[::2, ::2] + p[::2, 1::2] + p[1::2, ::2] + p[1::2, 1::2]) * np.float32(0.25)


def _mixing(n: int, m: int, bilinear: bool) -> np.ndarray:
    """m x n matrix that resamples n samples to m."""
    out, o = np.zeros((m, n)), np.arange(m)
    if bilinear:
        f = np.maximum(0, (o + 0.5) * n / m - 0.5)
        a = np.minimum(n - 1, f.astype(int))
        np.add.at(out, (o, a), 1 - (f - a))
        np.add.at(out, (o, np.minimum(n - 1, a + 1)), f - a)
        return out
    i = np.arange(n)
    share = np.minimum(i + 1, (o[:, None] + 1) * n / m) - np.maximum(i, o[:, None] * n / m)
    share = np.maximum(share, 0)
    return share / share.sum(axis=1, keepdims=True)


def resampled(plane: np.ndarray, h: int, w: int, bilinear: bool = False) -> np.ndarray:
    if plane.shape == (h, w):
        return plane
    across = (plane.astype(float) @ _mixing(plane.shape[1], w, bilinear).T).astype(np.float32)
    return (_mixing(plane.shape[0], h, bilinear) @ across.astype(float)).astype(np.float32)


def ssim_map(a: np.ndarray, b: np.ndarray, luminance: bool = True) -> np.ndarray:
    """Structural similarity, cropped by the radius on each side; planes under 11 are too small."""
    if min(a.shape) < 2 * RADIUS + 1:
        raise ValueError("plane too small")
    k = kernel(1.5, RADIUS)
    m1, m2 = blur(a, k), blur(b, k)
    v1, v2, cov = blur(a * a, k) - m1 * m1, blur(b * b, k) - m2 * m2, blur(a * b, k) - m1 * m2
    out = (2 * cov + C2) / (v1 + v2 + C2)
    if luminance:
        out = out * (2 * m1 * m2 + C1) / (m1 * m1 + m2 * m2 + C1)
    return out[RADIUS:-RADIUS, RADIUS:-RADIUS]


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    mse = float(np.mean(np.square((a - b).astype(float)))) if a.size else float("nan")
    return float("inf") if mse == 0 else float(-10 * np.log10(mse))


def downsample_consistency(source: np.ndarray, result: np.ndarray) -> tuple[float, float]:
    """PSNR and mean SSIM of the result, reduced onto the source."""
    if result.shape[0] < source.shape[0] or result.shape[1] < source.shape[1]:
        raise ValueError("result is smaller than its source")
    r = resampled(result, *source.shape)
    return psnr(source, r), float(ssim_map(source, r).mean())


def octave_ssim(a: np.ndarray, b: np.ndarray, octaves: int = 4) -> tuple[list[float], float]:
    """Mean SSIM of each Laplacian band, finest first, and of what remains."""
    if a.shape != b.shape:
        h, w = np.minimum(a.shape, b.shape)
        a, b = resampled(a, h, w), resampled(b, h, w)
    bands = []
    while len(bands) < octaves and min(a.shape) >= 2 * (2 * RADIUS + 1):
        na, nb = half(a), half(b)
        bands.append(float(ssim_map(a - resampled(na, *a.shape, True), b - resampled(nb, *b.shape, True), False).mean()))
        a, b = na, nb
    return bands, float(ssim_map(a, b).mean())


def xyb(rgb: np.ndarray) -> np.ndarray:
    bias = np.float32(0.0037930732552754493)
    mix = np.array([[0.30, 0.622, 0.078], [0.23, 0.692, 0.078], [0.24342268924547819, 0.20476744424496821, 0.5518098657995536]], np.float32)
    m = np.cbrt(rgb @ mix.T + bias) - np.cbrt(bias)
    x, y = 0.5 * (m[..., 0] - m[..., 1]), 0.5 * (m[..., 0] + m[..., 1])
    return np.stack([x * 14 + np.float32(0.42), y + np.float32(0.01), m[..., 2] - y + np.float32(0.55)])


def channel_statistics(a: np.ndarray, b: np.ndarray, k: np.ndarray, blur_with=blur) -> np.ndarray:
    """[norm, statistic]: L1 and L4 of structural error, artifacts and lost detail."""
    m1, m2 = blur_with(a, k), blur_with(b, k)
    cross, own = blur_with(a * b, k) - m1 * m2, (blur_with(a * a, k) - m1 * m1) + (blur_with(b * b, k) - m2 * m2)
    error = np.maximum(1 - (1 - np.square((m1 - m2).astype(float))) * (2.0 * cross.astype(float) + C2) / (own.astype(float) + C2), 0)
    edge = (1.0 + np.abs(b - m2)) / (1.0 + np.abs(a - m1)) - 1
    maps = np.stack([error, np.maximum(edge, 0), np.maximum(-edge, 0)]).astype(float)
    return np.stack([maps.mean(axis=(1, 2)), (maps**4).mean(axis=(1, 2)) ** 0.25])


def ssimulacra2(a: np.ndarray, b: np.ndarray, blur_with=blur) -> float:
    """Score of two sRGB images, uint8 [h, w, 3]; 100 for equal ones. With fewer than six scales the
    weights follow each other all the same."""
    if a.shape != b.shape or min(a.shape[:2]) < 8:
        raise ValueError("images must have one size of at least 8 x 8")
    c = np.arange(256, dtype=np.float32) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4).astype(np.float32)
    p, q, k, scales = linear[a], linear[b], kernel(1.5, 6), []
    while len(scales) < 6 and min(p.shape[:2]) >= 8:
        x, y = xyb(p), xyb(q)
        scales.append(np.stack([channel_statistics(x[i], y[i], k, blur_with) for i in range(3)]))
        p, q = half(p), half(q)
    pooled = np.abs(np.stack(scales, axis=1)).reshape(-1)  # channel, scale, norm, statistic
    s = float(pooled @ np.array(WEIGHTS[: len(pooled)])) * 0.9562382616834844
    s = 6.248496625763138e-5 * s**3 - 0.020884521182843837 * s**2 + 2.326765642916932 * s
    return 100 - 10 * s**0.6276336467831387 if s > 0 else 100.0


def warp(plane: np.ndarray, flow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward warp of [h, w(, c)] by [h, w, 2]; what comes from outside is invalid."""
    h, w = plane.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    fx, fy = x + flow[..., 0], y + flow[..., 1]
    valid = (fx >= 0) & (fy >= 0) & (fx <= w - 1) & (fy <= h - 1)
    fx, fy = np.clip(fx, 0, w - 1), np.clip(fy, 0, h - 1)
    x0, y0 = fx.astype(int), fy.astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = ((fx - x0), (fy - y0)) if plane.ndim == 2 else ((fx - x0)[..., None], (fy - y0)[..., None])
    out = (plane[y0, x0] * (1 - tx) + plane[y0, x1] * tx) * (1 - ty) + (plane[y1, x0] * (1 - tx) + plane[y1, x1] * tx) * ty
    return out, valid


def blend(fresh: np.ndarray, warped: np.ndarray, valid: np.ndarray, strength: float, tolerance: float) -> np.ndarray:
    """Where fresh and warped agree the warped sample prevails; channels share one agreement."""
    gap = np.abs(fresh - warped)
    gap = gap.mean(axis=2) if gap.ndim == 3 else gap
    w = strength * np.maximum(0, 1 - gap * (1 / tolerance if tolerance > 0 else 0)) * valid
    w = w[..., None] if fresh.ndim == 3 else w
    return w * warped + (1 - w) * fresh


class Stabiliser:
    """State: the last stabilised output. A cut or another size starts anew."""

    def __init__(self, strength: float = 0.6, tolerance: float = 0.15):
        self.strength, self.tolerance, self.last = strength, tolerance, None

    def reset(self) -> None:
        self.last = None

    def next(self, frame: np.ndarray, flow: np.ndarray | None = None) -> np.ndarray:
        if self.last is not None and self.last.shape == frame.shape:
            moved, valid = warp(self.last, flow if flow is not None else np.zeros((*frame.shape[:2], 2)))
            frame = blend(frame, moved, valid, self.strength, self.tolerance)
        self.last = frame
        return frame


def scaled_flow(flow: np.ndarray, h: int, w: int) -> np.ndarray:
    """Flow on another grid; displacements grow with their axis."""
    fy, fx = h / flow.shape[0], w / flow.shape[1]
    return np.stack([resampled(flow[..., 0].astype(np.float32), h, w, True) * fx, resampled(flow[..., 1].astype(np.float32), h, w, True) * fy], axis=-1)

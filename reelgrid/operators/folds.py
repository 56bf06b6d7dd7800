"""Folds over clips, where a decision depends on earlier ones.

Rows are shuffled by clip and sorted, with spills, within their task; they then stream through, and what
is carried from row to row is a window or a value, never the clip. Time is linear in a clip's frames.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


class CutDetector:
    """One clip's causal detector; what is carried is the window and the frames since the last cut.

    Until there is enough history nothing fires, and the window only grows. A fired cut stays out of the
    window; an outlier that comes too soon after a cut enters it clamped to the threshold.
    """

    def __init__(self, window: list[float] | None = None, since: int = 1 << 30, k: float = 2.0, floor: float = 0.01, size: int = 48, history: int = 12, gap: int = 6, mad: bool = False):
        self.window, self.since = deque(window or []), since
        self.sorted = sorted(self.window)
        self.k, self.floor, self.size, self.history, self.gap, self.mad = k, floor, max(4, size), max(2, history), max(1, gap), mad

    def threshold(self) -> float:
        s = self.sorted
        middle = s[len(s) // 2]
        if self.mad:
            return middle + self.k * max(sorted(abs(v - middle) for v in s)[len(s) // 2], self.floor)
        high = s[int(0.9 * (len(s) - 1) + 0.5)]
        return high + self.k * max(high - middle, self.floor)

    def next(self, delta: float) -> bool:
        cut, entry, warm = False, delta, len(self.window) < self.history
        if not warm:
            t = self.threshold()
            cut = delta > t and self.since >= self.gap
            entry = min(delta, t)
        self.since = 0 if cut else self.since + 1
        if not cut:
            self.window.append(entry)
            insort(self.sorted, entry)
            if not warm and len(self.window) > self.size:
                del self.sorted[bisect_left(self.sorted, self.window.popleft())]
        return cut

    def run(self, idx: np.ndarray, score: np.ndarray) -> tuple[np.ndarray]:
        """The frames of a part of the clip that are cuts."""
        return (idx[[self.next(v) for v in score.tolist()]],)


class Shots:
    """Starts of shots: the first frame, and where the distance exceeds the limit at least gap frames after the last start."""

    def __init__(self, limit: float, gap: int):
        self.limit, self.gap, self.place, self.last = limit, gap, 0, None

    def run(self, idx: np.ndarray, score: np.ndarray) -> tuple[np.ndarray]:
        out = []
        for j, v in enumerate(score.tolist()):
            if self.last is None or (v > self.limit and self.place - self.last >= self.gap):
                self.last = self.place
                out.append(j)
            self.place += 1
        return (idx[out],)


def blend(fresh: float, before: float, strength: float, inverse: float) -> float:
    w = max(0.0, 1.0 - abs(fresh - before) * inverse) * strength
    return w * before + (1.0 - w) * fresh


class Blend:
    """Confidence blend with the blended sample before; the first passes through. No tolerance: full agreement."""

    def __init__(self, strength: float, tolerance: float, last: float | None = None):
        self.strength, self.inverse, self.last = strength, 1 / tolerance if tolerance > 0 else 0.0, last

    def next(self, v: float) -> float:
        self.last = v if self.last is None else blend(v, self.last, self.strength, self.inverse)
        return self.last

    def run(self, idx: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return idx, np.array([self.next(v) for v in score.tolist()])


class ShotBlend:
    """A detector and a stabiliser together: at a cut the stabiliser starts anew, before the frame of the new shot."""

    def __init__(self, detector: CutDetector, blend: Blend, before: float | None = None):
        self.detector, self.blend, self.before = detector, blend, before

    def next(self, v: float) -> tuple[bool, float]:
        cut = self.before is not None and self.detector.next(abs(v - self.before))
        if cut:
            self.blend.last = None
        self.before = v
        return cut, self.blend.next(v)

    def run(self, idx: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        told = [self.next(v) for v in score.tolist()]
        return idx, np.array([c for c, _ in told]), np.array([v for _, v in told])


def folded(rows: DataFrame, new: Callable[[], object], results: str, by: str = "clip", order: str = "idx", value: str = "score") -> DataFrame:
    """by and the results (names and kinds, as in DDL) that a fold gives for each clip's rows in their order.

    new() makes the state of a clip; its run(idx, values) takes the next rows and gives arrays of results.
    """
    named = [x.split() for x in results.split(", ")]
    kinds = [ARROW[k] for _, k in named]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        for b in batches:
            keys = b.column(0)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            idx, values = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            for begin, end in zip(cuts, cuts[1:]):
                own = keys[begin].as_py()
                if state is None or own != key:
                    state, key = new(), own
                out = state.run(idx[begin:end], values[begin:end])
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(out[0]), keys.type), *[pa.array(x, k) for x, k in zip(out, kinds)]], [by, *[n for n, _ in named]])

    kind = rows.schema[by].dataType.simpleString()
    some = rows.select(by, rows[order].cast("long").alias(order), rows[value].cast("double").alias(value))
    return some.repartition(by).sortWithinPartitions(by, order).mapInArrow(scan, f"{by} {kind}, {results}")

"""Stateful stream operators: the causal cut detector and the bounded reorder buffer.

State is bounded for each key: a window of deltas, or at most `depth` packets. Nothing is dropped as
late; a watermark would. Rows of a key must come in their order (cuts) or may be displaced by up to
`depth` places (reorder), as in a decoder.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Blend, CutDetector, ShotBlend


def causal_cuts(deltas: DataFrame, **options) -> DataFrame:
    """A stream of (clip, idx, score) -> the cuts (clip, idx)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, since = state.get if state.exists else ([], 1 << 30)
        detector = CutDetector(window, since, **options)
        rows = pd.concat(parts).sort_values("idx")
        cuts = [int(i) for i, d in zip(rows["idx"], rows["score"]) if detector.next(float(d))]
        state.update((list(detector.window), detector.since))
        yield pd.DataFrame({"clip": [key[0]] * len(cuts), "idx": cuts})

    return deltas.groupBy("clip").applyInPandasWithState(run, "clip long, idx long", "window array<double>, since long", "append", GroupStateTimeout.NoTimeout)


def reorder(rows: list[tuple], held: list[tuple], depth: int = 32) -> tuple[list[tuple], list[tuple]]:
    """Rows (pts, ...) come in; what the buffer can't hold goes out, the least time first."""
    heap, out = [tuple(h) for h in held], []
    heapq.heapify(heap)
    for r in rows:
        heapq.heappush(heap, tuple(r))
        if len(heap) > depth:
            out.append(heapq.heappop(heap))
    return out, sorted(heap)


def reordered(packets: DataFrame, depth: int = 32) -> DataFrame:
    """A stream of (track, arrival, pts) -> the packets (track, place, pts) that have left the buffer."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pts, place = state.get if state.exists else ([], 0)
        rows = pd.concat(parts).sort_values("arrival")
        out, held = reorder([(int(p),) for p in rows["pts"]], [(p,) for p in pts], depth)
        state.update(([p for (p,) in held], place + len(out)))
        yield pd.DataFrame({"track": [key[0]] * len(out), "place": range(place, place + len(out)), "pts": [p for (p,) in out]})

    return packets.groupBy("track").applyInPandasWithState(run, "track long, place long, pts long", "pts array<long>, place long", "append", GroupStateTimeout.NoTimeout)


class ShotBlends(StatefulProcessor):
    """A clip's detector and stabiliser, carried between micro-batches: the detector's window is a list
    state, and what else they carry (frames since the cut, last frame, last stabilised value) one value."""

    def __init__(self, strength: float, tolerance: float, detector: dict):
        self.strength, self.tolerance, self.options = strength, tolerance, detector

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "delta double")
        self.held = handle.getValueState("held", "since long, before double, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("idx")
        since, before, last = self.held.get() if self.held.exists() else (1 << 30, None, None)
        window = [x[0] for x in self.window.get()] if self.window.exists() else []
        both = ShotBlend(CutDetector(window, since, **self.options), Blend(self.strength, self.tolerance, last), before)
        told = [both.next(float(v)) for v in frames["score"]]
        if both.detector.window:
            self.window.put([(v,) for v in both.detector.window])
        self.held.update((both.detector.since, both.before, both.blend.last))
        yield pd.DataFrame({"clip": [key[0]] * len(told), "idx": frames["idx"].to_numpy(), "cut": [c for c, _ in told], "v": [v for _, v in told]})

    def close(self) -> None:
        pass


#: transformWithState needs this store.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shot_blended(frames: DataFrame, strength: float, tolerance: float, **detector) -> DataFrame:
    """A stream of (clip, idx, score), in order within a clip -> (clip, idx, cut, v), as segment.shot_blended().

    The session's state store must be RocksDB (ROCKSDB).
    """
    return frames.groupBy("clip").transformWithStateInPandas(ShotBlends(strength, tolerance, detector), "clip long, idx long, cut boolean, v double", "Append", "None")

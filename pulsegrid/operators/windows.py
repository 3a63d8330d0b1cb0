"""Greedy selection of clean windows.

Where a clip's next window starts depends on the one before it (a rejected one restarts at the end of a broken interval), so a
clip is swept in order of time. The sweep reads broken intervals, never samples, in one sorted stream of all clips
of a partition and holds those of one window at a time: neither a clip nor its windows are gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.operators.gaps import broken_intervals
from pulsegrid.schema import WINDOW


class Sweep:
    """One clip's search; times count from its first sample."""

    def __init__(self, clip: str, first: float, last: float, regions: int, config: Config):
        self.clip, self.first, self.length, self.config = clip, first, last - first, config
        self.need = min(config.min_valid_regions, regions)
        self.start, self.live = 0.0, [[] for _ in range(regions)]
        self.accepted: list[tuple] = []
        self.index = 0

    def _restart(self, own: list[tuple[float, float]], end: float) -> float | None:
        """None where a region passes; else the end of its first overlap after which the rest would pass."""
        cut = [(max(s, self.start), min(e, end)) for s, e in own]
        lengths = [e - s for s, e in cut if e > s]
        ends = [e for s, e in cut if e > s]
        longest = 0.0
        for k in range(len(lengths) - 1, -1, -1):  # from the last overlap on which can't be kept
            longest = max(longest, lengths[k])
            if longest > self.config.max_gap_s or sum(lengths[k:]) > self.config.max_total_gap_s:
                return ends[k]
        return None

    def advance(self, until: float) -> None:
        """Decide every window that ends by ``until``: all intervals that begin before it are known."""
        c = self.config
        while (end := self.start + c.window_s) <= self.length + 1e-9 and end <= until:
            restarts = [self._restart(own, end) for own in self.live]
            failed = [r for r in restarts if r is not None]
            if len(restarts) - len(failed) >= self.need:
                self.index += 1
                self.accepted.append((f"{self.clip}_{self.index}", self.clip, self.index, self.start, end, self.first + self.start, [r is None for r in restarts]))
                self.start += c.step_s
            else:
                self.start = min(failed)
            self.live = [[x for x in own if x[1] > self.start] for own in self.live]

    def broken(self, region: int, start: float, end: float) -> None:
        self.advance(start)
        if end > self.start:
            self.live[region].append((start, end))


def find_windows(samples: DataFrame, config: Config = DEFAULT, regions: tuple[str, ...] | None = None) -> DataFrame:
    """Accepted windows of samples (clip, region, t, valid), numbered from 1 within each clip."""
    names = regions or config.regions
    spans = samples.groupBy("clip").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t")).filter("last_t > first_t")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("region")) - 1
    rows = spans.join(broken_intervals(samples, config).filter(F.col("region").isin(*names)), "clip", "left").select("clip", "first_t", "last_t", place.cast("int").alias("place"), "start_t", "end_t")
    fields = [f.split()[0] for f in WINDOW.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, out = None, []

        def rows_out() -> pa.RecordBatch:
            held = list(zip(*out, strict=True)) or [()] * len(fields)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types, strict=True)], fields)

        for batch in batches:
            for clip, first, last, region, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sweep is None or sweep.clip != clip:
                    if sweep is not None:
                        sweep.advance(inf)
                        out += sweep.accepted
                    sweep = Sweep(clip, first, last, len(names), config)
                if start is not None:
                    sweep.broken(region, start - first, end - first)
                if len(sweep.accepted) + len(out) > 4096:
                    out += sweep.accepted
                    sweep.accepted.clear()
                    yield rows_out()
        if sweep is not None:
            sweep.advance(inf)
            out += sweep.accepted
        yield rows_out()

    return rows.repartition("clip").sortWithinPartitions("clip", "start_t", "end_t", "place").mapInArrow(run, WINDOW)


def fixed_timeline(frames: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Replaces recorded times by an even spread of each clip's frames over ``clip_s`` seconds (frame_idx counts from 0)."""
    n = frames.groupBy("clip").agg((F.max("frame_idx") + 1).alias("n"))
    even = F.when(F.col("n") > 1, F.lit(config.clip_s) * F.col("frame_idx") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return frames.join(n, "clip").withColumn("t", even).drop("n")

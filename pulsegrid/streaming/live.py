"""Streaming forms of two operators (an addition: batch stages need none of this).

A stream of landmark or value samples is smoothed with per-key state, and clean series are counted in sliding windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions.smoothing import OneEuro


def sliding_validity(stream: DataFrame, *, delay: str = "1 minute", window: str = "20 seconds", step: str = "15 seconds") -> DataFrame:
    """Per clip and sliding window: samples and the share of valid ones, of a stream (clip, ts, valid) with late data up to ``delay``."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    per = rows.groupBy(F.window("ts", window, step), "clip").agg(F.count("*").alias("n"), F.avg(F.col("valid").cast("double")).alias("valid_share"))
    return per.select("clip", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "valid_share")


def smoothed(stream: DataFrame, rate: float, config: Config = DEFAULT) -> DataFrame:
    """One-Euro smoothing of a stream (clip, frame_idx, value): per clip the filter's last value and speed are the state.

    A missing value resets the filter and stays missing. Rows of one batch are taken in frame order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = OneEuro(rate, config)
        if state.exists:
            value, speed = state.get
            if value is not None:
                f.value, f.speed = np.array([value]), np.array([speed])
        rows = pd.concat(list(batches)).sort_values("frame_idx")
        out = []
        for v in rows.value:
            if v is None or np.isnan(v):
                f.reset()
                out.append(None)
            else:
                out.append(float(f.step(np.array([v]))[0]))
        state.update((None, None) if f.value is None else (float(f.value[0]), float(f.speed[0])))
        yield pd.DataFrame({"clip": key[0], "frame_idx": rows.frame_idx.to_numpy(), "smooth": out})

    return stream.groupBy("clip").applyInPandasWithState(run, "clip string, frame_idx long, smooth double", "value double, speed double", "append", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SMOOTHED = "clip string, frame_idx long, ts timestamp, smooth double"


class _InOrder(StatefulProcessor):
    """One-Euro smoothing of a clip's frames in the order of their times, whatever order they arrive in.

    Frames wait in a buffer by frame number until the watermark has passed their time: by then every frame that isn't too late is
    there, and those before go through the filter in order. Timers fire where the buffer ends; once a clip has been
    silent for ``idle_ms`` of event time its state goes.
    """

    def __init__(self, rate: float, idle_ms: int, config: Config):
        self.rate, self.idle_ms, self.config = rate, idle_ms, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "frame_idx long", "ms long, value double")
        self.filter = handle.getValueState("filter", "value double, speed double")
        self.last = handle.getValueState("last", "ms long")

    def _release(self, clip: str, until_ms: int) -> Iterator[pd.DataFrame]:
        ready = sorted((ms, k[0], value) for k, (ms, value) in self.buffer.iterator() if ms <= until_ms)
        if not ready:
            return
        f = OneEuro(self.rate, self.config)
        if (held := self.filter.get()) is not None and held[0] is not None:
            f.value, f.speed = np.array([held[0]]), np.array([held[1]])
        out = []
        for _, k, value in ready:
            self.buffer.removeKey((k,))
            if value is None or np.isnan(value):
                f.reset()
                out.append(None)
            else:
                out.append(float(f.step(np.array([value]))[0]))
        self.filter.update((None, None) if f.value is None else (float(f.value[0]), float(f.speed[0])))
        yield pd.DataFrame({"clip": clip, "frame_idx": [r[1] for r in ready], "ts": pd.to_datetime([r[0] for r in ready], unit="ms"), "smooth": pd.Series(out, dtype=float)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest, passed = None, timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for k, ms, value in zip(part.frame_idx.tolist(), part.ms.tolist(), part.value.tolist(), strict=True):
                if ms <= passed:  # its successors may be out already
                    continue
                self.buffer.updateValue((k,), (ms, None if value is None or np.isnan(value) else value))
                latest = ms if latest is None else max(latest, ms)
        before = self.last.get()
        if latest is not None and (before is None or latest > before[0]):
            if before is not None:
                for at in (before[0], before[0] + self.idle_ms):
                    self.handle.deleteTimer(at)
            self.last.update((latest,))
            self.handle.registerTimer(latest)
            self.handle.registerTimer(latest + self.idle_ms)
        yield from self._release(key[0], passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key[0], timerValues.getCurrentWatermarkInMs())
        last = self.last.get()
        if last is not None and expiredTimerInfo.getExpiryTimeInMs() >= last[0] + self.idle_ms:
            for state in (self.buffer, self.filter, self.last):
                state.clear()

    def close(self) -> None:
        pass


def smoothed_in_order(stream: DataFrame, rate: float, *, delay: str = "1 minute", idle_s: float = 600.0, config: Config = DEFAULT) -> DataFrame:
    """One-Euro smoothing of a stream (clip, frame_idx, ts, value) whose frames come up to ``delay`` late and in any order.

    A frame is given once the watermark has passed its time; results equal the batch form's on the frames that were in time. Later ones are
    dropped. A missing value resets the filter and stays missing. After ``idle_s`` without a frame (in event time) a clip's state is gone, and
    a frame after that begins anew. Times count in milliseconds; frames of one millisecond go by number. The session's state store is set to RocksDB, which such operators need.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.select("clip", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    rows = rows.filter("ts IS NOT NULL AND frame_idx IS NOT NULL").withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("clip").transformWithStateInPandas(_InOrder(rate, int(idle_s * 1000), config), SMOOTHED, "Append", "EventTime")

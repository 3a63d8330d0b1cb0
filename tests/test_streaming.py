"""Smoothing of frames that arrive late and shuffled, against the batch form."""

import os

import numpy as np
import pandas as pd
import pytest

from pulsegrid.functions.smoothing import smooth_series
from pulsegrid.streaming import live

START = pd.Timestamp("2024-01-01")


def run_batches(spark, tmp_path, batches, name, **options):
    """Each table of (clip, frame_idx, seconds, value) as one micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        df = pd.DataFrame(rows, columns=["clip", "frame_idx", "s", "value"])
        df["ts"] = (START + pd.to_timedelta(df.pop("s"), unit="s")).astype("datetime64[us]")
        df.to_parquet(folder / f"{i:03d}.parquet", index=False)
        os.utime(folder / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema("clip string, frame_idx long, value double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    try:
        q = live.smoothed_in_order(stream, 30.0, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return spark.table(name).collect(), q.recentProgress
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_shuffled_frames_give_the_batch_result(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames, want = [], {}
    for clip in ("a", "b"):
        values = rng.random(90)
        values[[20, 21, 55]] = np.nan
        smooth = smooth_series(values[:, None], 30.0)[:, 0]
        want |= {(clip, k): s for k, s in enumerate(smooth)}
        frames += [(clip, k, k / 30, float(v)) for k, v in enumerate(values)]
    # a frame comes up to 1.5 seconds late: places in the stream by time and a delay
    frames.sort(key=lambda f: f[2] + rng.uniform(0, 1.5))
    batches = [frames[i : i + 30] for i in range(0, len(frames), 30)]
    flush = [[("a", 1000, 60.0, 1.0), ("b", 1000, 60.0, 1.0)], [("a", 2000, 120.0, 1.0)]]
    got, _ = run_batches(spark, tmp_path, batches + flush, "in_order", delay="2 seconds")
    rows = {(r.clip, r.frame_idx): r.smooth for r in got if r.frame_idx < 1000}
    assert len(rows) == len([r for r in got if r.frame_idx < 1000]) == 180
    for key, s in want.items():
        assert (rows[key] is None and np.isnan(s)) or rows[key] == pytest.approx(s)
    assert any(a[2] > b[2] for batch in batches for a, b in zip(batch, batch[1:], strict=False))


def test_late_frames_are_dropped_and_silent_clips_forgotten(spark, tmp_path):
    batches = [[("a", 0, 0.0, 1.0), ("a", 1, 1.0, 2.0)], [("x", 0, 100.0, 1.0)], [("a", 2, 2.0, 9.0), ("x", 1, 101.0, 1.0)], [("x", 2, 300.0, 1.0)], [("x", 3, 301.0, 1.0), ("a", 5, 400.0, 7.0)], [("x", 9, 900.0, 1.0)], [("x", 10, 901.0, 1.0)]]
    got, progress = run_batches(spark, tmp_path, batches, "late", delay="5 seconds", idle_s=50.0)
    a = {r.frame_idx: r.smooth for r in got if r.clip == "a"}
    two = smooth_series(np.array([[1.0], [2.0]]), 30.0)[:, 0]
    assert set(a) == {0, 1, 5} and a[1] == pytest.approx(two[1]) and a[5] == 7.0  # frame 2 was too late; frame 5 begins anew

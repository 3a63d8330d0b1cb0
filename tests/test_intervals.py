"""Range joins by cells, the sweep for windows and streamed resampling against plain loops."""

import time
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import Config
from pulsegrid.functions.resample import pchip
from pulsegrid.operators import gaps, intervals, resampling, windows
from tests.test_series import direct_intervals

CONFIG = Config()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("closed", [True, False])
def test_points_meet_the_ranges_that_hold_them(spark, seed, closed):
    rng = np.random.default_rng(seed)
    ranges = [(int(rng.integers(0, 3)), float(s), float(s + rng.choice([-1, 0, 0.5, 7, 40]))) for s in np.round(rng.uniform(-20, 60, 40), 1)] + [(1, None, 5.0), (None, 0.0, 9.0)]
    points = [(int(rng.integers(0, 3)), float(t), i) for i, t in enumerate(np.round(rng.uniform(-25, 80, 200), 1))] + [(1, None, 900), (None, 1.0, 901)]
    a = spark.createDataFrame(ranges, "k int, s double, e double")
    b = spark.createDataFrame(points, "k int, t double, i int")
    got = sorted((r.k, r.s, r.e, r.i) for r in intervals.points_inside(a, b, ["k"], start="s", end="e", at="t", width=3.0, closed=closed).collect())
    inside = lambda s, t, e: s <= t <= e if closed else s <= t < e
    assert got == sorted((k, s, e, i) for k, s, e in ranges for q, t, i in points if None not in (k, s, e, t) and k == q and inside(s, t, e))


@pytest.mark.parametrize("seed", range(3))
def test_ranges_meet_once(spark, seed):
    rng = np.random.default_rng(seed)
    make = lambda n: [(int(rng.integers(0, 2)), float(s), float(s + rng.choice([0, 0.5, 3, 6, 50]))) for s in np.round(rng.uniform(0, 60, n), 1)]
    left, right = make(30), make(30)
    got = intervals.overlapping(spark.createDataFrame(left, "k int, s double, e double"), spark.createDataFrame(right, "k int, u double, v double"), ["k"], left_range=("s", "e"), right_range=("u", "v"), width=3.0)
    assert sorted(map(tuple, got.collect())) == sorted((k, s, e, u, v) for k, s, e in left for q, u, v in right if k == q and min(e, v) > max(s, u))


def test_a_clip_of_a_million_samples_meets_few_windows_and_is_spread(spark):
    n, fps = 1_000_000, 30.0
    samples = spark.range(n).select(F.lit("c").alias("clip"), (F.col("id") / fps).alias("t"))
    starts = spark.range(int(n / fps / 15) - 1).select(F.lit("c").alias("clip"), (F.col("id") * 15.0).alias("w_start"), (F.col("id") * 15.0 + 20.0).alias("w_end"))
    cells = intervals.reached(starts, "w_start", "w_end", 15.0)
    met = cells.groupBy("_cell").count().withColumnRenamed("count", "w").join(samples.groupBy(F.floor(F.col("t") / 15).alias("_cell")).count(), "_cell").agg(F.sum(F.col("w") * F.col("count"))).first()[0]
    assert met <= 3.1 * n  # of 2,221 windows a sample meets three at most
    began = time.time()
    out = intervals.points_inside(starts, samples, ["clip"], start="w_start", end="w_end", at="t", width=15.0)
    assert {r[0] for r in out.groupBy("w_start").count().select("count").distinct().collect()} == {601}
    assert time.time() - began < 60
    spread = intervals.points_inside(starts, samples, ["clip"], start="w_start", end="w_end", at="t", width=15.0).hint("shuffle_hash").groupBy(F.spark_partition_id()).count().count()
    assert spread > 1


def plain_search(t, valid, config):
    """The definition as a loop over one clip; ``valid`` by region."""
    t = np.asarray(t) - t[0] if len(t) else np.asarray(t)
    if len(t) < 2:
        return []
    broken = [direct_intervals(t, v, config.gap_factor) for v in valid]
    start, out = 0.0, []
    ok = lambda x: max(x, default=0.0) <= config.max_gap_s and sum(x) <= config.max_total_gap_s
    while start + config.window_s <= t[-1] + 1e-9:
        end, mask, restarts = start + config.window_s, [], []
        for own in broken:
            cut = [(max(s, start), min(e, end)) for s, e in own if min(e, end) > max(s, start)]
            lengths = [e - s for s, e in cut]
            mask.append(ok(lengths))
            if not mask[-1]:
                restarts.append(next(cut[k][1] for k in range(len(cut)) if ok(lengths[k + 1 :])))
        if sum(mask) >= min(config.min_valid_regions, len(mask)):
            out.append((start, end, mask))
            start += config.step_s
        else:
            start = min(restarts)
    return out


def test_windows_of_a_thousand_clips_equal_a_plain_search(spark):
    rng = np.random.default_rng(5)
    config = replace(CONFIG, window_s=20.0, step_s=15.0)
    frames, want = [], {}
    for c in range(1000):
        n = int(rng.choice([0, 1, 2, 30, 150, 400]))
        t = rng.uniform(0, 5) + np.cumsum(rng.choice([0.25, 0.25, 0.25, 0.25, 0.25, 2.0], n, p=[0.2, 0.2, 0.2, 0.2, 0.197, 0.003]))
        valid = []
        for _ in CONFIG.regions:
            v = np.ones(n, bool)
            for _ in range(int(rng.integers(0, 5)) if n else 0):
                a = int(rng.integers(0, n))
                v[a : a + int(rng.choice([1, 2, 3, 4, 4, 5, 8, 40]))] = False
            valid.append(v)
        frames += [pd.DataFrame({"clip": f"c{c}", "region": r, "t": t, "valid": v}) for r, v in zip(CONFIG.regions, valid, strict=True) if n]
        want[f"c{c}"] = plain_search(t, valid, config)
    df = spark.createDataFrame(pd.concat(frames)).repartition(7)
    got = {}
    for w in sorted(windows.find_windows(df, config).collect(), key=lambda w: (w.clip, w["index"])):
        assert w.segment == f"{w.clip}_{w['index']}" and w["index"] == len(got.get(w.clip, [])) + 1
        got.setdefault(w.clip, []).append((w.t_start, w.t_end, w.region_mask))
    assert got == {c: x for c, x in want.items() if x} and sum(map(len, got.values())) > 1000


def test_a_long_clip_is_swept_with_little_held(spark):
    """Two hundred thousand broken intervals in one clip: the sweep holds a window's alone."""
    rows = spark.range(200_000).select(F.lit("c").alias("clip"), F.lit("forehead").alias("region"), (F.col("id") * 2.0).alias("start_t"), (F.col("id") * 2.0 + 0.1).alias("end_t"))
    sweep = windows.Sweep("c", 0.0, 400_000.0, 3, CONFIG)
    most = 0
    for r in rows.toLocalIterator():
        sweep.broken(0, r.start_t, r.end_t)
        most = max(most, sum(map(len, sweep.live)))
    sweep.advance(float("inf"))
    assert most <= 30 and sweep.index == len(sweep.accepted) == int((400_000 - 20) / 15) + 1


def test_gates_do_not_depend_on_how_cells_are_cut(spark):
    rng = np.random.default_rng(2)
    broken = spark.createDataFrame([("c", str(rng.choice(["a", "b"])), float(s), float(s + rng.exponential(4))) for s in rng.uniform(0, 300, 60)], "clip string, region string, start_t double, end_t double")
    wins = spark.createDataFrame([("c", 15.0 * k, 15.0 * k + 20.0) for k in range(20)], "clip string, w_start double, w_end double")
    rows = [sorted(map(str, gaps.overlaps(wins, broken, replace(CONFIG, step_s=w)).select("region", "w_start", "o_start", "o_end").collect())) for w in (0.7, 15.0, 1000.0)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 60


def test_resampled_windows_equal_one_call_for_each(spark):
    rng = np.random.default_rng(6)
    config = replace(CONFIG, window_s=2.0, step_s=1.5, fps=10.0)
    data, wins = [], []
    for c in range(9):
        t = np.cumsum(rng.choice([0.03, 0.1, 0.2], 150))
        for r in config.regions:
            for x in t:
                v = None if rng.random() < 0.1 else float(rng.random())
                data.append((f"c{c}", r, float(x), v, v, v, int(rng.integers(0, 99))))
        wins += [(f"c{c}_{k}", f"c{c}", k, 0.0, 0.0, 1.5 * k, [bool(b) for b in rng.random(3) < 0.8]) for k in range(6)]
    samples = spark.createDataFrame(data, "clip string, region string, t double, r double, g double, b double, pixel_count int")
    w = spark.createDataFrame(wins, "segment string, clip string, index int, t_start double, t_end double, abs_start double, region_mask array<boolean>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # windows go on from batch to batch
    try:
        got = {(r.segment, x["name"]): x for r in resampling.resample(samples, w, config).collect() for x in r.regions}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    seen = 0
    for segment, clip, _, _, _, start, mask in wins:
        grid = start + np.arange(20) / 10
        for region, ok in zip(config.regions, mask, strict=True):
            own = sorted((t, g, n) for c, r, t, g, _, _, n in data if c == clip and r == region and start <= t <= start + 2.0)
            if not own:
                assert (segment, region) not in got
                continue
            t, g, n = (np.array([np.nan if v is None else v for v in x], float) for x in zip(*own, strict=True))
            x = got[segment, region]
            want = pchip(t, g[:, None], grid, config.support_slack) if ok else None
            assert x["valid"] == ok and (x["g"] is None) == (want is None)
            assert np.allclose(x["px"], np.interp(grid, t, n) if ok else 0, atol=1e-4)
            if want is not None:
                seen += 1
                assert np.allclose(x["g"], want[:, 0], atol=1e-5)
    assert seen > 40

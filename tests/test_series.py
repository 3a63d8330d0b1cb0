"""Gaps, windows, grids and regions against direct loops and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import Config
from pulsegrid.functions.resample import pchip
from pulsegrid.operators import combine, gaps, resampling, windows

CONFIG = Config()


def rows_of(clip, t, valid_by_region):
    return [(clip, r, float(x), bool(v)) for r, valid in valid_by_region.items() for x, v in zip(t, valid, strict=True)]


def direct_intervals(t, valid, factor=2.0):
    """A plain state machine."""
    if len(t) < 2:
        return []
    dt, out, start = float(np.median(np.diff(t))), [], None
    for i, (x, v) in enumerate(zip(t, valid, strict=True)):
        if not v:
            start = x if start is None else start
        elif start is not None:
            out.append((start, x))
            start = None
        elif i and x - t[i - 1] > factor * dt:
            out.append((t[i - 1] + dt, x))
    if start is not None:
        out.append((start, t[-1]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_intervals_match_a_direct_loop(spark, seed):
    rng = np.random.default_rng(seed)
    data, want = [], set()
    for c in range(6):
        n = int(rng.integers(0, 60))
        t = np.cumsum(rng.choice([1.0, 1.0, 1.0, 5.0], n))
        for r in ("a", "b"):
            valid = rng.random(n) > 0.3
            data += rows_of(f"c{c}", t, {r: valid})
            want |= {(f"c{c}", r, round(s, 6), round(e, 6)) for s, e in direct_intervals(t, valid)}
    df = spark.createDataFrame(data, "clip string, region string, t double, valid boolean")
    got = {(x.clip, x.region, round(x.start_t, 6), round(x.end_t, 6)) for x in gaps.broken_intervals(df, CONFIG).collect()}
    assert got == want


def clean(seconds=180, fps=4):
    return np.arange(seconds * fps + 1) / fps


def found(spark, data, config=CONFIG):
    df = spark.createDataFrame(data, "clip string, region string, t double, valid boolean")
    return sorted(windows.find_windows(df, config).collect(), key=lambda x: x["index"])


def test_a_clean_clip_has_eleven_windows(spark):
    t = clean()
    out = found(spark, rows_of("x", t, {r: np.ones(len(t), bool) for r in CONFIG.regions}))
    assert [w.segment for w in out] == [f"x_{k}" for k in range(1, 12)]
    assert [w.t_start for w in out] == [15.0 * k for k in range(11)]


def test_one_bad_region_is_allowed_two_are_not(spark):
    t = clean()
    ok = np.ones(len(t), bool)
    out = found(spark, rows_of("x", t, {"forehead": ok, "lcheek": ok, "rcheek": ~ok}))
    assert len(out) == 11 and all(sum(w.region_mask) == 2 for w in out)
    assert found(spark, rows_of("x", t, {"forehead": ok, "lcheek": ~ok, "rcheek": ~ok})) == []


def test_a_rejected_window_restarts_after_the_gap(spark):
    t = clean()
    bad = (t >= 30) & (t < 32)
    ok = np.ones(len(t), bool)
    out = found(spark, rows_of("x", t, {"forehead": ~bad, "lcheek": ~bad, "rcheek": ok}))
    starts = [w.t_start for w in out]
    assert starts[0] == 0.0 and 32.0 in starts
    for s in starts:
        assert max(0.0, min(32.0, s + 20) - max(30.0, s)) <= 1.0


def test_an_exact_second_of_gap_passes_and_many_short_ones_fail(spark):
    t = np.arange(0, 40, 1 / 32)
    ok, one = np.ones(len(t), bool), ~((t >= 4) & (t < 5))
    assert found(spark, rows_of("x", t, {"forehead": one, "lcheek": one, "rcheek": ok}))[0].t_start == 0.0
    many = np.ones(len(t), bool)
    for k in range(7):
        many &= ~((t >= 2 * k + 1) & (t < 2 * k + 1.9))
    assert found(spark, rows_of("x", t, {"forehead": many, "lcheek": many, "rcheek": ok}))[0].t_start > 0


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_clips_have_no_windows(spark, n):
    data = rows_of("x", np.arange(n), {r: np.ones(n, bool) for r in CONFIG.regions})
    assert found(spark, data) == []


def test_smoothed_counts_and_weighted_mean_match_numpy(spark):
    rng = np.random.default_rng(1)
    n, regions = 50, CONFIG.regions
    counts = rng.integers(0, 200, (n, 3))
    colour = rng.random((n, 3))
    colour[rng.random((n, 3)) < 0.2] = np.nan
    data = [("c", i, r, None if np.isnan(colour[i, k]) else float(colour[i, k]), int(counts[i, k])) for i in range(n) for k, r in enumerate(regions)]
    df = spark.createDataFrame(data, "clip string, frame_idx int, region string, g double, pixel_count int").withColumn("r", F.col("g")).withColumn("b", F.col("g"))
    got = {x.frame_idx: x.g for x in combine.combine_regions(df, CONFIG).collect()}
    smooth = np.stack([np.convolve(counts[:, k], np.ones(30), "same") for k in range(3)], 1)
    want = (np.nan_to_num(colour) * smooth).sum(1) / smooth.sum(1)
    assert np.allclose([got[i] for i in range(n)], want)


def test_frames_without_weight_are_null(spark):
    df = spark.createDataFrame([("c", 0, "a", 1.0, 1.0, 1.0, 0)], "clip string, frame_idx int, region string, r double, g double, b double, pixel_count int")
    assert combine.combine_regions(df).first().g is None


def test_linear_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(2)
    t, v, at = np.sort(rng.random(20) * 10), rng.random(20), np.linspace(-1, 11, 40)
    samples = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(t, v, strict=True)], "k string, t double, v double")
    grid = spark.createDataFrame([("k", float(a)) for a in at], "k string, t double")
    got = {round(x.t, 9): x.v for x in resampling.interpolate_linear(samples, grid, ["k"], "v").collect()}
    assert np.allclose([got[round(a, 9)] for a in at], np.interp(at, t, v))


def test_duplicate_times_are_averaged_or_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("a", 2.0, None), ("a", 2.0, 1.0)], "k string, t double, v double")
    assert {x.t: x.v for x in resampling.collapse_duplicates(df, ["k", "t"], ["v"]).collect()} == {1.0: 3.0, 2.0: None}


def test_pchip_keeps_shape_and_support():
    t = np.array([0.0, 1, 2, 3, 4])
    x = np.array([0.0, 1, 1, 3, 3])[:, None]
    out = pchip(t, x, np.linspace(0, 4, 41))
    assert np.allclose(out[::10], x)
    assert (np.diff(out[:, 0]) >= -1e-12).all() and np.allclose(out[10:21, 0], 1.0)
    assert np.allclose(pchip(np.array([0.0, 1]), np.array([[0.0], [2]]), np.array([0.25]))[0], 0.5)
    assert pchip(t, x, np.linspace(-2, 4, 5)) is None
    assert pchip(t[:1], x[:1], t) is None
    twice = pchip(np.array([0.0, 0, 1, 2]), np.array([[0.0], [2], [3], [4]]), np.array([0.0]))
    assert np.allclose(twice, 1.0)


def test_a_rejected_region_is_cleared_and_a_ragged_edge_is_missing(spark):
    config = Config(window_s=2.0, fps=5.0)
    t = np.arange(0, 2.05, 0.1)
    data = [("c", r, float(x), float(x), 1.0, 1.0, 100) for r in config.regions for x in t if not (r == "lcheek" and x < 0.5)]
    samples = spark.createDataFrame(data, "clip string, region string, t double, r double, g double, b double, pixel_count int")
    w = spark.createDataFrame([("c_1", "c", 1, 0.0, 2.0, 0.0, [True, True, False])], "segment string, clip string, index int, t_start double, t_end double, abs_start double, region_mask array<boolean>")
    row = resampling.resample(samples, w, config).first()
    by = {r["name"]: r for r in row.regions}
    assert np.allclose(by["forehead"]["r"], np.arange(10) / 5, atol=1e-6)
    assert by["lcheek"]["r"] is None and sum(by["lcheek"]["px"]) > 0 and by["lcheek"]["valid"]
    assert by["rcheek"]["r"] is None and sum(by["rcheek"]["px"]) == 0 and not by["rcheek"]["valid"]


def test_validity_counts_nan_and_null_as_missing(spark):
    df = spark.createDataFrame([("c", 0, 1.0, 1.0, 1.0), ("c", 1, float("nan"), 1.0, 1.0), ("c", 2, None, 1.0, 1.0)], "clip string, frame_idx int, r double, g double, b double")
    assert [x.valid for x in combine.region_valid(df).orderBy("frame_idx").collect()] == [True, False, False]
    assert combine.frame_validity(combine.region_valid(df)).first().valid_share == pytest.approx(1 / 3)

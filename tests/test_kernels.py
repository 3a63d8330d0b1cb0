"""Signal kernels, smoothing, regions and networks against closed forms and finite differences."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT
from pulsegrid.functions import dsp, nets, regions, smoothing
from pulsegrid.operators import frames, learning


def test_band_pass_coefficients():
    b, a, zi = dsp.butterworth(3, 0.9, 2.8, 30.0)
    assert np.allclose(b, [0.00549166, 0, -0.01647498, 0, 0.01647498, 0, -0.00549166], atol=1e-8)
    assert np.allclose(a, [1, -4.91980245, 10.34406936, -11.90227585, 7.90876373, -2.8785614, 0.44872255], atol=1e-7)
    assert np.allclose(zi, [-0.00549166, -0.00549166, 0.01098332, 0.01098332, -0.00549166, -0.00549166], atol=1e-7)


def test_band_pass_keeps_the_pulse_and_drops_the_drift():
    t = np.arange(600) / 30
    x = np.sin(2 * np.pi * 1.5 * t)[None]
    y = dsp.bandpass(x + 5 + 0.1 * t, 30.0)
    assert np.abs(y[0, 100:500] - x[0, 100:500]).max() < 0.05
    short = np.arange(21.0)[None]
    assert np.allclose(dsp.bandpass(short, 30.0, trend=False), short - short.mean())
    assert not np.allclose(dsp.bandpass(np.arange(22.0)[None] ** 2, 30.0, trend=False), np.arange(22.0) ** 2 - (np.arange(22.0) ** 2).mean())


def test_detrending_a_line_leaves_nothing():
    assert np.abs(dsp.detrend(np.arange(100.0)[None] * 3 + 2)).max() < 1e-6
    assert np.allclose(dsp.detrend(np.array([[1.0, 2, 3]])), [[-1, 0, 1]])


def test_spectral_rate():
    t = np.arange(600) / 30
    rate, conf = dsp.spectral_hr(np.stack([np.sin(2 * np.pi * 1.2 * t), np.ones(600), np.full(600, np.nan)]), 30.0)
    assert abs(rate[0] - 72) < 0.44 and conf[0] > 10
    assert np.isnan(rate[1:]).all() and (conf[1:] == 0).all()
    assert np.isnan(dsp.spectral_hr(np.ones((1, 10)), 30.0)[0][0])


def test_waves_find_a_pulse_and_pos_ignores_gain():
    rng = np.random.default_rng(0)
    t = np.arange(600) / 30
    beat = np.sin(2 * np.pi * 1.3 * t)
    rgb = 100 + np.stack([0.3 * beat, beat, 0.5 * beat], -1)[None] + 0.05 * rng.normal(size=(1, 600, 3))
    for wave in dsp.WAVES.values():
        assert abs(dsp.spectral_hr(wave(rgb, 30.0), 30.0)[0][0] - 78) < 1
    assert np.allclose(dsp.pos_wave(rgb, 30.0), dsp.pos_wave(rgb * np.array([2.0, 3, 0.5]), 30.0), atol=1e-6)
    assert not dsp.pos_wave(rgb[:, :40], 30.0).any()


def test_level_and_swing():
    dc, ac = dsp.ac_dc(np.stack([np.full(600, 3.0), np.full(600, np.nan)]), 30.0)
    assert dc.tolist() == [3.0, 0.0] and ac.tolist() == [0.0, 0.0]
    with pytest.raises(ValueError):
        dsp.ac_dc(np.r_[np.ones(30), np.nan][None], 30.0)


def test_smoothing_resets_at_missing_frames():
    x = np.random.default_rng(0).random((30, 5, 2))
    x[10] = np.nan
    y = smoothing.smooth_series(x, 30.0)
    assert np.isnan(y[10]).all() and np.allclose(y[11], x[11]) and np.allclose(y[0], x[0])
    assert np.allclose(y[11:], smoothing.smooth_series(x[11:], 30.0))
    still = smoothing.smooth_masks(np.full((4, 3, 3), 255, np.uint8), 30.0)
    assert (still == 255).all()


def test_hull_fill_and_erosion():
    square = np.array([[2.0, 2], [10, 2], [10, 10], [2, 10], [6, 6]])
    assert len(regions.convex_hull(square)) == 4
    mask = regions.fill_hull((16, 16), square)
    assert mask[2:11, 2:11].all() and mask.sum() == 81 * 255
    assert (regions.erode(mask, 3) > 0).sum() == 9
    assert regions.erode(mask, 0) is mask
    assert not regions.fill_hull((4, 4), np.zeros((3, 2))).any()


def test_frames_to_region_signals(spark):
    pts = np.zeros((478, 2))
    for name, centre in zip(regions.POLYGONS, ((24, 14), (14, 44), (44, 44)), strict=True):
        idx = list(regions.POLYGONS[name])
        angle = np.linspace(0, 2 * np.pi, len(idx), endpoint=False)
        pts[idx] = np.array(centre) + 12 * np.stack([np.cos(angle), np.sin(angle)], -1)
    face = [{"x": float(x), "y": float(y)} for x, y in pts]
    bgr = np.zeros((60, 60, 3), np.uint8)
    bgr[...] = (10, 20, 30)
    data = [("c", k, k / 30, 60, 60, bytearray(bgr.tobytes()), bytearray(np.ones((60, 60), np.uint8).tobytes()), None if k == 2 else face) for k in range(4)]
    df = spark.createDataFrame(data, "clip string, frame_idx int, t double, h int, w int, bgr binary, cls binary, pts array<struct<x:double,y:double>>")
    out = {(r.frame_idx, r.region): r for r in frames.region_signals(df, DEFAULT).collect()}
    assert (out[0, "forehead"].r, out[0, "forehead"].g, out[0, "forehead"].b) == (30.0, 20.0, 10.0)
    assert out[0, "forehead"].pixel_count >= 80 and out[2, "forehead"].pixel_count == 0 and out[2, "forehead"].r is None


def test_parameter_counts():
    assert nets.parameters(nets.PulseNet()) == 255_553
    assert nets.parameters(nets.HbNet()) == 18_625
    assert nets.parameters(nets.PulseNet(n_features=60, drop=0.15)) == 267_906
    at, bpm = nets.band()
    assert (at[0], at[-1], len(at)) == (46, 227, 182) and abs(bpm[0] - 40.43) < 0.01 and abs(bpm[-1] - 199.51) < 0.01


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    net = nets.PulseNet(4, width=6, drop=0, n_features=5)
    x, f, hr, hb = rng.normal(size=(5, 4, 120)), rng.normal(size=(5, 5)), rng.uniform(60, 150, 5), rng.normal(size=5)

    def loss():
        return net.loss(hr, net.forward(x, True, f), hb=hb)

    _, d, d_hb = loss()
    net.backward(d, d_hb)
    for leaf in net.leaves():
        for k, v in leaf.p.items():
            at = tuple(rng.integers(n) for n in v.shape)
            g, old = leaf.g[k][at], v[at]
            v[at] = old + 1e-5
            up = loss()[0]
            v[at] = old - 1e-5
            down = loss()[0]
            v[at] = old
            assert abs((up - down) / 2e-5 - g) < 1e-4 * max(1, abs(g))


def test_saving_and_loading_keeps_predictions():
    x = np.random.default_rng(0).normal(size=(3, 60))
    net = nets.HbNet()
    assert np.allclose(nets.load(nets.HbNet(seed=5), nets.save(net)).predict(x), net.predict(x))


def test_frames_of_clips_in_many_batches(spark):
    """Small batches, several clips in a partition, shuffled rows: the same signals as clip by clip in one batch."""
    rng = np.random.default_rng(3)
    rows = []
    for clip in "abc":
        face = [{"x": float(x), "y": float(y)} for x, y in rng.uniform(5, 55, (478, 2))]
        for k in range(7):
            bgr, cls = rng.integers(0, 256, (60, 60, 3)).astype(np.uint8), rng.integers(0, 2, (60, 60)).astype(np.uint8)
            rows.append((clip, k, k / 30, 60, 60, bytearray(bgr.tobytes()), bytearray(cls.tobytes()), None if k == 3 else face))
    order = rng.permutation(len(rows))
    schema = "clip string, frame_idx int, t double, h int, w int, bgr binary, cls binary, pts array<struct<x:double,y:double>>"
    plain = [frames.region_signals(spark.createDataFrame([r for r in rows if r[0] == c], schema).coalesce(1)).collect() for c in "abc"]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = frames.region_signals(spark.createDataFrame([rows[i] for i in order], schema)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(repr, got)) == sorted(repr(r) for p in plain for r in p) and len(got) == 63
    assert frames.region_signals(spark.createDataFrame([], schema)).count() == 0


def test_a_model_is_written_read_and_trained_on(spark, tmp_path):
    model = learning.Model("hb", nets.save(nets.HbNet(seed=3)), {"seed": 3}, [0.5] * 60, [2.0] * 60)
    learning.write_model(spark, model, str(tmp_path / "m"))
    assert learning.read_model(spark, str(tmp_path / "m")) == model
    region = lambda x: [{"name": n, "valid": True, "r": [x] * 600, "g": [x + 1] * 600, "b": [x + 2] * 600, "px": [90.0] * 600} for n in DEFAULT.regions]
    schema = "regions array<struct<name:string,valid:boolean,r:array<float>,g:array<float>,b:array<float>,px:array<float>>>, hb double"
    rows = spark.createDataFrame([(region(100.0 + k), 10.0 + k) for k in range(6)], schema).coalesce(1).cache()
    best, history = learning.train(rows, rows, "hb", rounds=2, start=model, keep=str(tmp_path / "kept"))
    assert len(history) == 2 and best.mean == model.mean and best.weights != model.weights
    last = learning.read_model(spark, str(tmp_path / "kept" / "last"))
    assert learning.read_model(spark, str(tmp_path / "kept" / "best")).weights == best.weights
    again, _ = learning.train(rows, rows, "hb", rounds=1, start=last)
    assert again.options == {"seed": 3}
    with pytest.raises(ValueError):
        learning.train(rows, rows, "hr", start=model)


def test_split_sizes():
    assert [learning.split_sizes(n) for n in (3, 4, 10)] == [(1, 1, 1), (2, 1, 1), (8, 1, 1)]
    with pytest.raises(ValueError):
        learning.split_sizes(2)
    assert len(learning.feature_names()) == 60


def test_training_reads_its_rows_once(spark):
    """However many rounds there are, what makes the rows runs once for each row, and few rows are one partition's."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("float")
    def seen(k):
        read.add(1)
        return 100.0 + k

    region = lambda n: F.struct(F.lit(n).alias("name"), F.lit(True).alias("valid"), *[F.array_repeat((F.col("x") + i).cast("float"), 600).alias(c) for i, c in enumerate("rgb")], F.array_repeat(F.lit(90.0).cast("float"), 600).alias("px"))
    rows = lambda n: spark.range(0, n, numPartitions=4).withColumn("x", seen("id")).select(F.array(*map(region, DEFAULT.regions)).alias("regions"), F.col("id").cast("double").alias("hb"))
    options = {"seed": 3, "drop": 0.0}
    _, history = learning.train(rows(12), rows(5), "hb", options=options, rounds=3)
    assert read.value == 17 and [h["epoch"] for h in history] == [1, 2, 3]
    _, one = learning.train(rows(12).coalesce(1), rows(5), "hb", options=options, rounds=3)
    assert all(np.isfinite(h["train_loss"]) and np.isclose(h["train_loss"], o["train_loss"], rtol=0.2) for h, o in zip(history, one, strict=True))


def test_features_of_a_batch_hold_few_rows(monkeypatch):
    """A batch of any length is taken some rows at a time, with the values of the whole batch at once."""
    region = lambda n, k: {"name": n, "valid": n != "rcheek", **{c: None if n == "rcheek" else [k + i + j % 7 for j in range(600)] for i, c in enumerate("rgb")}, "px": [90.0 + k] * 600}
    made = pd.Series([[region(n, float(k)) for n in DEFAULT.regions] for k in range(70)])
    taken, arrays = [], learning.sample_arrays
    monkeypatch.setattr(learning, "SLICE", 32)
    monkeypatch.setattr(learning, "sample_arrays", lambda s, config=DEFAULT: taken.append(len(s)) or arrays(s, config))
    got = learning.features_of(pa.array(made))
    assert taken == [32, 32, 6]
    assert np.array_equal(np.stack(got.to_pandas()), learning.hb_features(*arrays(made)))
    assert len(learning.features_of(pa.array(made)[:0])) == 0

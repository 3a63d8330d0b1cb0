"""Ranks and splits, augmentation, loud lookups, the feature cache and result rows."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulsegrid.config import Config
from pulsegrid.functions import dsp, nets
from pulsegrid.operators import augment, cache, combine, learning, lookup, ranking, scoring
from pulsegrid.schema import RESULT

# ---- ranks ----


def test_ranks_are_global_and_count_equal_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), str(b)) for a, b in zip(rng.integers(0, 50, 2000), rng.integers(0, 9, 2000), strict=True)] + [(None, "x"), (None, None)]
    got = sorted(ranking.ranked(spark.createDataFrame(rows, "a int, b string").repartition(6), ["a", "b"]).collect(), key=lambda r: r["rank"])
    key = lambda r: tuple((x is not None, x) for x in r[:2])
    assert [r["rank"] for r in got] == list(range(2002)) and [key(r) for r in got] == sorted(key(r) for r in got)
    assert ranking.ranked(spark.createDataFrame([], "a int"), ["a"]).collect() == []


@pytest.mark.parametrize("n", [3, 4, 10, 57])
def test_parts_have_exact_sizes_whatever_the_partitions(spark, n):
    df = spark.createDataFrame([(f"p{i % n}", i) for i in range(3 * n)], "subject string, i int")
    a, b = ({r.subject: r.part for r in ranking.split_by_rank(df.repartition(k), "subject", seed=7).collect()} for k in (1, 5))
    order = sorted((f"p{i}" for i in range(n)), key=lambda s: hashlib.md5(f"7:{s}".encode()).hexdigest())
    _, n_val, n_test = learning.split_sizes(n)
    assert a == b == {s: "test" if i < n_test else "val" if i < n_test + n_val else "train" for i, s in enumerate(order)}


def test_too_few_subjects_are_an_error(spark):
    with pytest.raises(ValueError):
        ranking.split_by_rank(spark.createDataFrame([("a",), ("b",)], "subject string"), "subject")


def test_ten_million_subjects_are_split_exactly(spark):
    df = spark.range(10_000_000).select(F.col("id").alias("subject"))
    counts = {r.part: r["count"] for r in ranking.split_by_rank(df, "subject").groupBy("part").count().collect()}
    assert counts == {"train": 8_000_000, "val": 1_000_000, "test": 1_000_000}


# ---- augmentation ----


def signals(spark, n=64, channels=12, t=40):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", rng.normal(size=(channels, t)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, signal array<array<double>>")


def uniform(seed, epoch, key, use):
    return int(hashlib.md5(f"{seed}:{epoch}:{key}:{use}".encode()).hexdigest()[:13], 16) / 2**52


def test_shift_and_loss_equal_a_direct_version(spark):
    rows, df = signals(spark)
    got = {r.key: r for r in augment.augmented(df, "key", "signal", seed=5, epoch=2, amplitude=0, noise=0).collect()}
    lost = 0
    for key, x in rows:
        shift = int(np.floor(uniform(5, 2, key, "shift") * 31)) - 15
        want = np.roll(np.array(x), shift, -1)
        region = int(uniform(5, 2, key, "region") * 3) if uniform(5, 2, key, "loss") < 0.3 else None
        if region is not None:
            lost += 1
            want[4 * region : 4 * region + 4] = 0
        assert got[key]["shift"] == shift and got[key].lost_region == region and np.array_equal(got[key].signal, want)
    assert 8 < lost < 32


def test_draws_depend_on_seed_epoch_and_key_alone(spark):
    _, df = signals(spark)
    collect = lambda d, **o: {r.key: r.signal for r in augment.augmented(d, "key", "signal", **o).collect()}
    base = collect(df, epoch=1)
    assert base == collect(df.repartition(7).orderBy(F.desc("key")), epoch=1)
    assert base != collect(df, epoch=2) and base != collect(df, epoch=1, seed=43)
    assert base == collect(df.withColumn("e", F.lit(1)), epoch="e")


def test_noise_and_amplitudes_have_the_stated_spread(spark):
    n, c, t = 300, 4, 60
    df = spark.range(n).select(F.col("id").alias("key"), F.array_repeat(F.array_repeat(F.lit(1.0), t), c).alias("signal"))
    x = np.array([r.signal for r in augment.augmented(df, "key", "signal", loss=0).collect()])
    assert abs(x.mean() - 1) < 0.01 and np.std(x.mean(2)) == pytest.approx(0.1, rel=0.1) and np.std(x - x.mean(2, keepdims=True)) == pytest.approx(0.05, rel=0.05)


def test_signals_that_are_missing_or_empty_stay_so(spark):
    df = spark.createDataFrame([("a", None), ("b", []), ("c", [[]]), ("d", [[1.0], [None]])], "key string, signal array<array<double>>")
    got = {r.key: r.signal for r in augment.augmented(df, "key", "signal", amplitude=0, noise=0).collect()}
    assert got == {"a": None, "b": [], "c": [[]], "d": [[1.0], [None]]}


SMALL = Config(window_s=4.0, fps=30.0)


def packed(spark, n=6, config=SMALL):
    rng = np.random.default_rng(2)
    t = np.arange(config.samples) / config.fps
    rows = []
    for i in range(n):
        regions = []
        for k, name in enumerate(config.regions):
            ok = not (k == 2 and i % 2)
            c = [(100 + rng.normal(size=len(t)) + np.sin(2 * np.pi * (1.0 + 0.2 * i) * t) * a).astype(np.float32).tolist() for a in (1, 2, 0.5)] if ok else [None] * 3
            px = rng.integers(80, 300, len(t)).astype(np.float32).tolist() if ok else [0.0] * len(t)
            regions.append((name, ok, *c, px))
        rows.append((f"1{i}_cam_x_1", regions))
    return spark.createDataFrame(rows, "segment string, regions array<struct<name:string,valid:boolean,r:array<float>,g:array<float>,b:array<float>,px:array<float>>>")


def test_network_channels_equal_the_kernel(spark):
    df = packed(spark)
    rows = df.withColumn("x", augment.network_channels(config=SMALL)).collect()
    for r in rows:
        want = nets.network_input(*learning.sample_arrays([r.regions], SMALL))[0]
        assert np.allclose(r.x, want, atol=1e-6)


# ---- lookups ----


def test_absent_keys_end_a_strict_lookup_by_name(spark):
    rows = spark.createDataFrame([(i,) for i in range(20)], "segment int")
    table = spark.createDataFrame([(i, f"p{i}") for i in range(20) if i != 13], "segment int, patient_id string")
    out, _ = lookup.looked_up(rows, table, ["segment"], ["patient_id"])
    with pytest.raises(PySparkException, match="no patient_id for segment = 13"):
        out.collect()
    fine, seen = lookup.looked_up(rows.filter("segment <> 13"), table, ["segment"], ["patient_id"])
    assert {(r.segment, r.patient_id) for r in fine.collect()} == {(i, f"p{i}") for i in range(20) if i != 13}
    lookup.require(seen)


def test_absent_keys_are_counted_and_named_by_the_same_job(spark):
    rows = spark.createDataFrame([(i % 25, "x") for i in range(100)] + [(None, "x")], "k int, v string")
    table = spark.createDataFrame([(i, None if i == 4 else "y") for i in range(23)], "k int, w string")
    out, seen = lookup.looked_up(rows, table, ["k"], ["w"], strict=False)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("lookup"))
    spark.sparkContext.setJobGroup("lookup", "lookup")
    try:
        assert len(out.collect()) == 101
        n = jobs()
        absent, names = lookup.absent_keys(seen)
        assert jobs() == n
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert absent == 13 and set(names) <= {"4", "23", "24", "NULL"} and len(names) >= 2
    with pytest.raises(LookupError, match="13 of 101 rows"):
        lookup.require(seen)


# ---- cache ----


def test_only_new_content_is_computed(spark, tmp_path):
    path, calls = f"file://{tmp_path}/cache", spark.sparkContext.accumulator(0)

    def compute(df):
        def run(batches):
            for b in batches:
                calls.add(len(b))
                yield b.assign(twice=b.x.map(lambda a: [2 * v for v in a]))

        return df.mapInPandas(run, "_key string, x array<double>, twice array<double>")

    def go(rows, **settings):
        before = calls.value
        out, computed = cache.cached(spark.createDataFrame(rows, "name string, x array<double>"), ["x"], compute, "twice", path, settings)
        n = calls.value - before
        assert {r["name"]: r.twice for r in out.collect()} == {a: None if x is None else [2 * v for v in x] for a, x in rows}
        assert computed.count() == n
        return n

    rows = [("a", [1.0]), ("b", [2.0, 3.0]), ("c", [1.0])]
    assert go(rows) == 2 and go(rows) == 0 and go([*rows, ("d", [4.0])]) == 1
    assert go(rows, fps=25) == 2 and go(rows, fps=25) == 0 and go(rows) == 0


# ---- result rows ----


def test_result_rows_equal_the_kernels_on_combined_colours(spark):
    samples = packed(spark)
    manifest = spark.createDataFrame(
        [(f"1{i}_cam_x_1", f"1{i}_cam_x", 0.0, 4.0, "" if i % 2 else "70.5", "80", "13.5" if i else "") for i in range(6)] + [("gone", "gone", 0.0, 4.0, "1", "2", "3")],
        "segment string, clip string, t_start double, t_end double, ppg_hr string, pulse string, hemoglobin string",
    )
    hb = learning.Model("hb", nets.save(nets.HbNet(seed=1)), {"seed": 1})
    out = scoring.results(samples, manifest, hb_model=hb, config=SMALL)
    assert [f"{n} {t}" for n, t in out.dtypes] == RESULT.split(", ")
    rows = {r.segment: r for r in out.collect()}
    assert len(rows) == 6
    frames = []
    for s in samples.collect():
        for x in s.regions:
            frames += [(s.segment, i, x["name"], *[None if x[c] is None else float(x[c][i]) for c in "rgb"], int(x["px"][i])) for i in range(SMALL.samples)]
    face = combine.combine_regions(spark.createDataFrame(frames, "clip string, frame_idx int, region string, r double, g double, b double, pixel_count int"), SMALL)
    series = {}
    for r in face.orderBy("clip", "frame_idx").collect():
        series.setdefault(r.clip, []).append((r.r, r.g, r.b))
    want_hb = {r.segment: r.hb_pred for r in learning.predict(samples, hb, SMALL).collect()}
    for name, r in rows.items():
        x = np.array(series[name])[None]
        for m, wave in dsp.WAVES.items():
            rate, conf = dsp.spectral_hr(wave(x, SMALL.fps, SMALL), SMALL.fps, SMALL)
            assert r[f"hr_{m}"] == pytest.approx(rate[0]) and r[f"conf_{m}"] == pytest.approx(conf[0], rel=1e-6)
        i = int(name[1])
        assert r.hr_label == (80.0 if i % 2 else 70.5) and r.hb_label == (13.5 if i else None) and r.hr_pred is None and r.hb_pred == pytest.approx(want_hb[name])

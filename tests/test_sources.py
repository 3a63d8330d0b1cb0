"""Archives of clips and recordings read in ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT
from pulsegrid.plans import reports
from pulsegrid.sources import archives, readers, sinks


def names(path):
    return sorted(p.name for p in path.iterdir()) if path.exists() else []


def masks(spark, clips, t=5, h=3, w=4):
    rng = np.random.default_rng(0)
    held = {c: rng.integers(0, 19, (t + i, h, w)).astype(np.uint8) for i, c in enumerate(clips)}
    rows = [(c, k, h, w, bytearray(m.tobytes())) for c, x in held.items() for k, m in enumerate(x)]
    return held, spark.createDataFrame(rows, "clip string, frame_idx int, h int, w int, cls binary")


def test_masks_come_back_and_clips_without_frames_have_the_empty_form(spark, tmp_path):
    held, df = masks(spark, ["a", "b", "c d"])
    path = f"file://{tmp_path}/m"
    archives.write(df.orderBy(F.rand(1)).repartition(4), path, "masks", clips=spark.createDataFrame([("a",), ("b",), ("c d",), ("none",)], "clip string"))
    assert names(tmp_path / "m") == ["a_seg.npz", "b_seg.npz", "c d_seg.npz", "none_seg.npz"]
    for c, x in held.items():
        assert np.array_equal(np.load(tmp_path / "m" / f"{c}_seg.npz")["masks"], x)
    empty = np.load(tmp_path / "m" / "none_seg.npz")["masks"]
    assert empty.shape == (0, 0, 0) and empty.dtype == np.uint8
    rows = {r.name: r for r in readers.npz(spark, path, ["masks"], "_seg.npz").collect()}
    assert rows["a"].shape == [5, 3, 4] and rows["none"].shape == [0, 0, 0]


def test_archives_that_are_there_are_left_alone(spark, tmp_path):
    held, df = masks(spark, ["a", "b"])
    path = f"file://{tmp_path}/m"
    archives.write(df.filter("clip = 'a'"), path, "masks")
    before = (tmp_path / "m" / "a_seg.npz").read_bytes()
    other = df.withColumn("cls", F.when(F.col("clip") == "a", F.expr("cast(repeat('x', 12) as binary)")).otherwise(F.col("cls")))
    archives.write(other, path, "masks")
    assert (tmp_path / "m" / "a_seg.npz").read_bytes() == before and names(tmp_path / "m") == ["a_seg.npz", "b_seg.npz"]
    archives.write(other, path, "masks", overwrite=True)
    assert set(np.load(tmp_path / "m" / "a_seg.npz")["masks"].ravel()) == {ord("x")}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    _, df = masks(spark, [f"c{i}" for i in range(8)])
    broken = df.withColumn("cls", F.when((F.col("clip") == "c5") & (F.col("frame_idx") == 3), F.expr("cast('short' as binary)")).otherwise(F.col("cls")))
    with pytest.raises(Exception, match="reshape"):
        archives.write(broken, f"file://{tmp_path}/m", "masks")
    assert names(tmp_path / "m") == []


def test_landmarks_signals_and_samples(spark, tmp_path):
    rng = np.random.default_rng(1)
    points = rng.random((4, 478, 3)).astype(np.float32)
    rows = [("a", k, None if k == 2 else [tuple(map(float, p)) for p in points[k]]) for k in range(4)]
    df = spark.createDataFrame(rows, "clip string, frame_idx int, pts array<struct<x:float,y:float,z:float>>")
    clips = spark.createDataFrame([("a",), ("z",)], "clip string")
    archives.write(df, f"file://{tmp_path}/l", "landmarks", clips=clips)
    got = np.load(tmp_path / "l" / "a_landmarks.npz")["landmarks"]
    want = points.copy()
    want[2] = np.nan
    assert np.array_equal(got, want, equal_nan=True) and np.load(tmp_path / "l" / "z_landmarks.npz")["landmarks"].shape == (0, 478, 3)

    signal = [("a", k, k / 30, r, None if (k + i) % 5 == 0 else k + i / 10, 2.0, 3.0, 100 * i + k) for k in range(12) for i, r in enumerate(DEFAULT.regions)]
    df = spark.createDataFrame(signal, "clip string, frame_idx int, t double, region string, r double, g double, b double, pixel_count int")
    archives.write(df, f"file://{tmp_path}/s", "signals", clips=clips)
    got = np.load(tmp_path / "s" / "a_signals.npz")
    assert got["signals"].shape == (12, 3, 3) and np.array_equal(got["timestamps"], np.arange(12) / 30) and got["pixel_counts"][7].tolist() == [7, 107, 207]
    assert np.isnan(got["signals"][5, 0, 0]) and got["signals"][6, 1].tolist() == [6.1, 2.0, 3.0]
    assert np.load(tmp_path / "s" / "z_signals.npz")["signals"].shape == (0, 3, 3)

    regions = [(n, n != "rcheek", *[[1.0 + i, 2.0, 3.0] if n != "rcheek" else None] * 3, [9.0, 8.0, 7.0]) for i, n in enumerate(reversed(DEFAULT.regions))]
    df = spark.createDataFrame([("a_1", 30.0, regions)], "segment string, fps double, regions array<struct<name:string,valid:boolean,r:array<float>,g:array<float>,b:array<float>,px:array<float>>>")
    archives.write(df, f"file://{tmp_path}/p", "samples")
    got = np.load(tmp_path / "p" / "a_1_sample.npz")
    assert got["signals"].shape == (3, 3, 3) and got["region_mask"].tolist() == [True, True, False] and got["fps"] == 30 and got["signals"][0, 0, 0] == 3 and np.isnan(got["signals"][:, 2]).all()


def test_a_long_recording_is_read_by_many_tasks(spark, tmp_path):
    """Twelve ranges of one file, blank and bad lines among them: numbers and values as from one pass."""
    folder = tmp_path / "ppg" / "10 20" / "after"
    folder.mkdir(parents=True)
    rng = np.random.default_rng(2)
    lines = [f"{v:.1f}  2024-01-01 14:{i // 60000 % 60:02d}:{i // 1000 % 60:02d}.{i % 1000:03d}" for i, v in enumerate(rng.normal(size=200_000))]
    for i in range(0, len(lines), 777):
        lines[i] = ["", "bad line é", "1.5", "\r"][i // 777 % 4]
    (folder / "x.PW").write_bytes("\n".join(lines).encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        rows = readers.recording_lines(spark, f"file://{tmp_path}/ppg")
        assert spark.read.text(f"file://{folder}/x.PW").rdd.getNumPartitions() >= 10
        got = {r.line_number: r.line for r in rows.collect()}
        good, bad = readers.pulse(spark, f"file://{tmp_path}/ppg")
        n_good, n_bad = good.agg(F.count("*"), F.min("seq"), F.max("seq")).first(), bad.groupBy("error").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 1: x.rstrip("\r") for i, x in enumerate(lines)}
    parsed = pd.Series(lines).str.strip()
    assert n_good[0] == int(parsed.map(lambda x: x != "" and not x.startswith("bad")).sum()) and n_good[2] == 200_000
    assert {r.error: r["count"] for r in n_bad} == {"bad value": int(parsed.str.startswith("bad").sum()), "bad time": int((parsed == "1.5").sum())}


def test_only_wanted_folders_are_listed(spark, tmp_path):
    for s in ("1", "2", "3,x", "[4]+"):
        for state in ("before", "after"):
            f = tmp_path / s / state
            f.mkdir(parents=True)
            (f / "a.PW").write_text(f"{state}\n1.0\n")
    path = f"file://{tmp_path}"
    rows = readers.recording_lines(spark, path, subjects=["1", "3,x", "[4]+"], states=["after"])
    assert {(r.subject, r.state, r.line_number, r.line) for r in rows.collect()} == {(s, "after", n, x) for s in ("1", "3,x", "[4]+") for n, x in ((1, "after"), (2, "1.0"))}
    read = {f.split("/")[-3] for f in rows.inputFiles()}
    assert "2" not in read and len(read) == 3 and len(readers.recording_lines(spark, path).inputFiles()) == 8
    assert readers.recording_lines(spark, path, subjects=[]).collect() == []


def test_signals_are_dealt_to_tasks_by_their_frames(spark, tmp_path, monkeypatch):
    """A task's frames, and with them its memory, don't grow with the table; a clip stays whole and in order, one without a name has no archive."""
    monkeypatch.setattr(archives, "FRAMES", 10)
    rows = spark.range(40 * 5 * 3).selectExpr("CAST(id % 40 AS STRING) AS clip", "CAST(id DIV 40 % 5 AS INT) AS frame_idx", "id DIV 200 AS k", "id DIV 40 % 5 / 2D AS t")
    rows = rows.select(F.when(F.col("clip") != "39", F.col("clip")).alias("clip"), "frame_idx", "t", F.element_at(F.array(*map(F.lit, DEFAULT.regions)), (F.col("k") + 1).cast("int")).alias("region"), *[(F.col("t") + F.col("k")).alias(c) for c in "rgb"], F.lit(7).alias("pixel_count"))
    sc = spark.sparkContext
    sc.setJobGroup("signals", "")
    try:
        archives.write(rows, f"file://{tmp_path}/s", "signals")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("signals")]
    assert max(sc.statusTracker().getStageInfo(i).numTasks for j in jobs for i in j.stageIds) == 20
    assert names(tmp_path / "s") == sorted(f"{i}_signals.npz" for i in range(39))
    for i in range(39):
        held = np.load(tmp_path / "s" / f"{i}_signals.npz")
        assert held["timestamps"].tolist() == [0, 0.5, 1, 1.5, 2] and np.array_equal(held["signals"], np.add.outer(held["timestamps"], np.arange(3))[:, :, None].repeat(3, 2))


def test_bundles_hold_many_recordings_and_are_read_in_ranges(spark, tmp_path):
    long = [("s 0/a+%", "x", i, f"{i}.5  é\x85") for i in range(20_000)]
    held = long + [(None, "x", 1, "b"), (None, "x", 0, "a"), ("", "x", 0, ""), ("", None, 0, "z\ty "), ("\\N", "a\tb", 0, "c")] + [(f"u{i}", "x", 0, f"{i}\r") for i in range(50)]
    path = f"file://{tmp_path}/b"
    sinks.bundles(spark.createDataFrame(held, "subject string, state string, at int, line string").orderBy(F.rand(3)), path, ["at"])
    assert len(list((tmp_path / "b").glob("*.txt"))) <= 4
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() >= 10
        got = [(r.subject, r.state, r.line_number - 1, r.line) for r in readers.bundle_lines(spark, path).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got, key=str) == sorted(((*r[:3], r[3].rstrip("\r")) for r in held), key=str)
    with pytest.raises(Exception, match="holds a line break"):
        sinks.bundles(spark.createDataFrame([("a", "x", 0, "1\n2")], "subject string, state string, at int, line string"), f"{path}2", ["at"])


def test_recordings_of_many_users_dont_take_a_file_each(spark, tmp_path, monkeypatch):
    """Users without an id are a recording, too."""
    shared = tmp_path / "shared"
    rows = spark.range(3_000).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", "nullif(id % 300, 7) AS user_id", "IF(id % 50 = 0, 'error', 'view') AS event_type", "id / 4 AS value", "'{}' AS props")
    rows.write.parquet(f"file://{tmp_path}/events.parquet")
    monkeypatch.setattr(reports, "shared_dir", lambda _: f"file://{shared}")
    got = reports.s9_recordings_in_ranges(spark, f"file://{tmp_path}").collect()
    assert len(list(shared.rglob("*.txt"))) <= 4
    none = [r for r in got if r.subject is None]
    assert len(got) == 294 and all(r.numbered for r in got) and [(r.good, r.timed, r.total) for r in none] == [(10, 10, sum((7 + 300 * k) / 4 for k in range(10)))]


def test_frame_counts(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", None)], "clip string, frame_idx int")
    assert {r.clip: r.frames for r in readers.frame_counts(df).collect()} == {"a": 2, "b": 0}

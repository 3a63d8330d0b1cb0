"""Every registered query with SQL against DuckDB, as the driver compares them; readers, sinks, streaming."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import labels, learning, metrics
from pulsegrid.plans import registry
from pulsegrid.sources import readers, sinks
from pulsegrid.streaming import live
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(map(tuple, df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns)
        return
    want = oracle.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, (int, float)) and u == pytest.approx(v, abs=2e-4, rel=1e-6)), (name, x, y)


def test_safe_ratio_covers_every_line_item(spark, oracle):
    want = {tuple(r) for r in oracle.execute("SELECT l_orderkey, l_linenumber FROM lineitem").fetchall()}
    assert {(r.k, r.i) for r in registry.QUERIES["m8_safe_ratio_all_lines"](spark, SF).collect()} == want and max(i for _, i in want) > 1


def test_colour_series_hold_every_vector(spark):
    from pulsegrid.plans import signals

    want = {round(float(r.x) + 10, 9) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("embedding")[0].alias("x")).collect()}
    got = {round(v, 9) for r in signals._colours(spark, SF).select(*[F.col(c)[0] for c in "rgb"]).collect() for v in r}
    assert got == want


def test_pulse_recordings(spark, tmp_path):
    folder = tmp_path / "ppg" / "1020" / "after"
    folder.mkdir(parents=True)
    (folder / "x.PW").write_bytes("1.5  2024-01-01 14:18:09.870\n\nbad 2024-01-01 14:18:09.880\n2.5 broken\n3.5\t2024-01-01 14:18:10.870\né\n".encode("latin-1"))
    good, bad = readers.pulse(spark, f"file://{tmp_path}/ppg")
    rows = good.orderBy("seq").collect()
    assert [(r.subject, r.state, r.seq, r.value, r.ts is None) for r in rows] == [("1020", "after", 1, 1.5, False), ("1020", "after", 4, 2.5, True), ("1020", "after", 5, 3.5, False)]
    assert {(r.line_number, r.error) for r in bad.collect()} == {(3, "bad value"), (4, "bad time"), (6, "bad value")}
    assert readers.pulse_rate(good, ["subject", "state"]).first().sampling_frequency == 1.0


def test_ground_truth(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿video,patient_id,pulse,hemoglobin\n/a/b/1_c_before.mp4,1,70,\n1_c_before.avi, 2 ,80,13.5\nz.mp4, ,1,1\n".encode())
    rows = readers.ground_truth(spark, f"file://{tmp_path}/t.csv").collect()
    assert [tuple(r) for r in rows] == [("1_c_before", "2", 80.0, 13.5)]


def test_listing_and_archives(spark, tmp_path):
    for name in ("a.mp4", "a.MKV", "b.AVI", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert {(r.clip, r.path[-3:]) for r in readers.listing(spark, f"file://{tmp_path}").collect()} == {("a", "MKV"), ("b", "AVI")}
    np.savez(tmp_path / "a_signals.npz", signals=np.arange(6.0).reshape(2, 3), fps=np.float32(30))
    rows = {r.key: r for r in readers.npz(spark, f"file://{tmp_path}", ["signals", "fps"], "_signals.npz").collect()}
    assert rows["signals"].name == "a" and rows["signals"].shape == [2, 3] and rows["signals"].values == list(map(float, range(6))) and rows["fps"].shape == []
    assert readers.named_by_suffix(spark, f"file://{tmp_path}", "_signals.npz").first().name == "a"


def test_frame_times(spark):
    df = spark.createDataFrame([("a", 1, "0.5"), ("a", 2, "N/A"), ("a", 3, " 1.5 "), ("b", 1, "2")], "clip string, line_number int, value string")
    assert {(r.clip, r.t, r.duration) for r in readers.frame_times(df).collect()} == {("a", 0.5, 1.0), ("a", 1.5, 1.0)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s_10", "s", 10, None), ("s_2", "s", 2, 1.5)], "segment string, clip string, index int, hr_pos double")
    sinks.manifest(df, f"file://{tmp_path}/m")
    back = readers.manifest(spark, f"file://{tmp_path}/m")
    assert len(back.columns) == 14 and [r["index"] for r in back.orderBy("index").collect()] == [2, 10]
    sinks.results(df, f"file://{tmp_path}/r")
    assert {r.segment: r.hr_pos for r in readers.results(spark, f"file://{tmp_path}/r").collect()} == {"s_10": None, "s_2": 1.5}
    assert sinks.table(df, f"file://{tmp_path}/t").count() == 2
    more = df.union(spark.createDataFrame([("u_1", "u", 1, 2.0)], df.schema))
    sinks.table(more, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 3
    sinks.history(spark, [{"epoch": 1, "loss": None}], f"file://{tmp_path}/h")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/h").collect()] == ["epoch,loss", "1,"]


def test_names(spark):
    df = spark.createDataFrame([("12_cam_before", "x"), ("abc_x", "abc_x_1"), ("", "77_a_1"), (None, "q")], "clip string, segment string")
    rows = df.select(labels.subject_of("clip", "segment").alias("s"), labels.clip_part("clip", 2).alias("p")).collect()
    assert [(r.s, r.p) for r in rows] == [("12", "before"), ("?", None), ("77", None), ("?", None)]


def test_reports_guard_small_and_flat_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0)] * 4 + [("b", 1.0, 2.0)] * 5 + [("b", None, 1.0), ("b", float("nan"), 1.0)], "g string, pred double, truth double")
    assert [r.g for r in metrics.hr_report(df, ["g"]).collect()] == ["b"]
    row = metrics.regression(df, ["g"], least=5).first()
    assert (row.g, row.n, row.mae, row.r, row.r2) == ("b", 5, 1.0, None, None)


def test_splits_follow_the_reference_order(spark):
    ids = [f"p{i:02d}" for i in range(20)]
    df = spark.createDataFrame([(i,) for i in ids * 2], "subject string")
    got = {r.subject: r.part for r in learning.split_subjects(df, "subject", seed=42).collect()}
    order = np.array(sorted(ids))
    np.random.default_rng(42).shuffle(order)
    assert got == {s: "test" if i < 2 else "val" if i < 4 else "train" for i, s in enumerate(order)}


def test_streaming_smoothing_matches_batch(spark, tmp_path):
    from pulsegrid.functions.smoothing import smooth_series

    values = np.random.default_rng(0).random(30)
    values[12] = np.nan
    for k in range(3):
        part = pd.DataFrame({"clip": "c", "frame_idx": np.arange(10 * k, 10 * k + 10), "value": values[10 * k : 10 * k + 10]})
        spark.createDataFrame(part).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    for k in range(3):  # one folder per batch keeps the order
        import shutil

        src = next((tmp_path / "in" / str(k)).glob("*.parquet"))
        (tmp_path / "flat").mkdir(exist_ok=True)
        shutil.copy(src, tmp_path / "flat" / f"{k}.parquet")
        import os

        os.utime(tmp_path / "flat" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("clip string, frame_idx long, value double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/flat")
    out = live.smoothed(stream, 30.0).writeStream.format("memory").queryName("smooth").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {r.frame_idx: r.smooth for r in spark.table("smooth").collect()}
    want = smooth_series(values[:, None], 30.0)[:, 0]
    assert all((got[i] is None and np.isnan(w)) or got[i] == pytest.approx(w) for i, w in enumerate(want))


def test_streaming_windows_plan(spark, tmp_path):
    df = spark.range(100).select(F.lit("c").alias("clip"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("id"))).alias("ts"), (F.col("id") % 2 == 0).alias("valid"))
    df.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/e")
    q = live.sliding_validity(stream).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live").agg(F.max("n")).first()[0] == 20


def test_regression_sends_means_to_rows(spark):
    """Rows of a group aren't shuffled to one task to meet their mean; NULL is a group as in SQL."""
    rows = [(None if i % 3 == 2 else i % 3, float(i % 11), float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, pred double, truth double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = metrics.regression(df, ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.g: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert set(got) == {0, 1, None}
    for g, r in got.items():
        p, y = np.array([x[1:] for x in rows if x[0] == g]).T
        assert r.n == 30 and np.isclose(r.naive_mae, np.abs(y - y.mean()).mean()) and np.isclose(r.r, np.corrcoef(p, y)[0, 1])

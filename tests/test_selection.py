"""Exact middle values by distributed selection, against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import metrics, selection


def direct(values):
    x = sorted(v for v in values if v is not None and not np.isnan(v))
    return (x[(len(x) + 1) // 2 - 1], x[len(x) // 2], len(x)) if x else None


@pytest.mark.parametrize("held", [1, 7, 100_000])
@pytest.mark.parametrize("seed", [0, 1])
def test_middle_of_groups_of_all_kinds(spark, seed, held):
    rng = np.random.default_rng(seed)
    groups = {
        "normal": rng.normal(size=700), "odd": rng.normal(size=31), "ties": rng.integers(0, 3, 500).astype(float), "flat": np.full(400, 2.5), "wide": rng.choice([-1, 1], 300) * 10.0 ** rng.uniform(-300, 300, 300),
        "zeros": np.array([0.0, -0.0] * 30), "infinite": np.r_[rng.normal(size=50), [np.inf] * 40, [-np.inf] * 3], "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "missing": np.array([np.nan] * 5),
        "halves": np.r_[np.full(50, 1.0), np.full(50, 9.0)], None: rng.exponential(size=90),
    }
    rows = [(g, None if np.isnan(v) else float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("odd", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.lower, r.upper, r.n) for r in selection.middle(df, ["g"], "x", held=held).collect()}
    assert got == {g: w for g in groups if (w := direct(groups[g]))}
    all_rows = selection.middle(df, [], "x", held=held).collect()
    assert [(r.lower, r.upper, r.n) for r in all_rows] == [direct([v for _, v in rows])]


def test_nothing_to_select(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert selection.middle(df, ["g"], "x").collect() == [] and selection.middle(df, [], "x", held=1).collect() == []


def test_one_group_of_all_rows_is_narrowed_in_few_passes(spark, monkeypatch):
    passes = []
    narrow = selection._narrowed
    monkeypatch.setattr(selection, "_narrowed", lambda *a: passes.append(1) or narrow(*a))
    n = 1_000_001
    df = spark.range(n).select((F.pow(F.col("id") - 400_000.0, 3)).alias("x"))
    row = selection.middle(df, [], "x", held=2_000).first()
    assert row.lower == row.upper == 100_000.0**3 and row.n == n and len(passes) <= 2


def test_capped_and_confident_rows_of_all_rows_together(spark):
    rng = np.random.default_rng(3)
    data = [(float(a), float(b), float(c)) for a, b, c in rng.normal(size=(501, 3))]
    df = spark.createDataFrame(data, "pred double, truth double, conf double")
    row = metrics.confident_half(df, [], "pred", "truth", "conf").first()
    conf = np.array([c for _, _, c in data])
    high = [abs(a - b) for a, b, c in data if c >= np.median(conf)]
    assert row.median_conf == np.median(conf) and row.n == 501 and row.n_high == len(high) and row.mae_high == pytest.approx(np.mean(high))
    med = sorted(a for a, _, _ in data)[250]
    cap = med + 3 * (sorted(abs(a - med) for a, _, _ in data)[250] + 1e-6)
    got = metrics.robust_cap(df, [], "pred").select("cap", "capped", "pred").collect()
    assert all(r.cap == pytest.approx(cap) and r.capped == min(r.pred, r.cap) for r in got) and len(got) == 501

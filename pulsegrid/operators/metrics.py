"""Accuracy reports as aggregate expressions: one pass over the rows, partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.operators import selection
from pulsegrid.scratch import written

EPS = 1e-12


def both(pred: str, truth: str) -> Column:
    """Both values are there and finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return F.coalesce(ok(pred) & ok(truth), F.lit(False))


def hr_report(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth", config: Config = DEFAULT) -> DataFrame:
    """n, MAE, share within 6 (in percent) and bias; only groups with enough rows."""
    error = F.col(pred) - F.col(truth)
    rows = df.filter(both(pred, truth))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), (F.avg((F.abs(error) <= config.within_bpm).cast("double")) * 100).alias("w6"), F.avg(error).alias("bias"))
    return out.filter(F.col("n") >= config.report_min_rows)


def methods_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per method: columns hr_<method> as (method, pred)."""
    return df.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in columns], "method", "pred").withColumn("method", F.regexp_replace("method", "^hr_", ""))


def regression(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth", least: int = 1) -> DataFrame:
    """n, MAE, RMSE, bias, r, R2, and the MAE of always saying the mean truth, with guards instead of divisions by zero.

    The naive MAE needs the group's mean beside each row: few groups' means are sent to all tasks, many are joined. NULL is a group like others.
    """
    rows = df.filter(both(pred, truth)).withColumn("_p", F.col(pred).cast("double")).withColumn("_y", F.col(truth).cast("double"))
    # means (one row per group) are written and, where they are few, sent to the rows: a shuffle by group would give a task a whole group
    means = rows.groupBy(*by).agg(F.avg("_y").alias("_m"), F.avg("_p").alias("_q"))
    rows = selection.beside(rows, written(means, "group-means"), by) if by else rows.crossJoin(F.broadcast(means))  # one row
    e, dy, dp = F.col("_p") - F.col("_y"), F.col("_y") - F.col("_m"), F.col("_p") - F.col("_q")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.sum(dy * dy).alias("_tot"), F.sum(e * e).alias("_res"), F.sum(dp * dp).alias("_pp"), F.sum(dp * dy).alias("_py"), F.avg(F.abs(dy)).alias("naive_mae"),
    )
    steady = (F.col("_tot") > EPS) & (F.col("_pp") > EPS)
    out = sums.withColumn("r2", F.when(F.col("_tot") > EPS, 1 - F.try_divide(F.col("_res"), F.col("_tot")))).withColumn("r", F.when(steady, F.try_divide(F.col("_py"), F.sqrt(F.col("_tot") * F.col("_pp")))))
    return out.withColumn("beats_naive", F.col("mae") < F.col("naive_mae")).filter(F.col("n") >= least).drop("_tot", "_res", "_pp", "_py")


def confident_half(df: DataFrame, by: list[str], pred: str, truth: str, confidence: str, config: Config = DEFAULT) -> DataFrame:
    """Per group: the median confidence of valid rows, and n, MAE and share within 6 of the rows that reach it."""
    rows = df.filter(both(pred, truth) & F.col(confidence).isNotNull())
    medians = selection.median(rows, by, confidence).select(*by, F.col("median").alias("median_conf"), "n")
    error = F.abs(F.col(pred) - F.col(truth))
    high = selection.beside(rows, medians, by).filter(F.col(confidence) >= F.col("median_conf"))
    return high.groupBy(*by, "median_conf", "n").agg(F.count("*").alias("n_high"), F.avg(error).alias("mae_high"), (F.avg((error <= config.within_bpm).cast("double")) * 100).alias("w6_high"))


def plot_limits(df: DataFrame, columns: list[str], low: float = 30.0) -> DataFrame:
    """Axis limits: the values' range widened to tens."""
    least, most = F.least(*[F.min(c) for c in columns]) if len(columns) > 1 else F.min(columns[0]), F.greatest(*[F.max(c) for c in columns]) if len(columns) > 1 else F.max(columns[0])
    return df.agg(F.greatest(F.lit(low), F.floor(least / 10) * 10 - 5).cast("double").alias("low"), (F.ceil(most / 10) * 10 + 5).cast("double").alias("high"))


def per_subject(df: DataFrame, subject: str, pred: str, truth: str, order: str) -> DataFrame:
    """Mean prediction and last truth of each subject."""
    return df.filter(both(pred, truth)).groupBy(subject).agg(F.avg(pred).alias("pred"), F.max_by(truth, order).alias("truth"), F.count("*").alias("n"))


def feature_norm(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation of each feature; a deviation under 1e-8 counts as 1."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in features], "feature", "x")
    out = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def best_epoch(history: DataFrame, metric: str, *, lowest: bool) -> DataFrame:
    """The first epoch with the best finite value of a metric."""
    rows = history.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    return rows.orderBy(F.col(metric).asc() if lowest else F.col(metric).desc(), "epoch").limit(1)


def robust_cap(df: DataFrame, by: list[str], value: str, k: float = 3.0) -> DataFrame:
    """Values capped at lower median + k * (lower median deviation + 1e-6), per group."""
    rows = selection.beside(df, selection.middle(df, by, value).select(*by, F.col("lower").alias("_med")), by).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    spread = selection.middle(rows, by, "_dev").select(*by, F.col("lower").alias("_mad"))
    return selection.beside(rows, spread, by).withColumn("cap", F.col("_med") + k * (F.col("_mad") + 1e-6)).withColumn("capped", F.least(F.col(value), F.col("cap"))).drop("_med", "_mad")


def clip_summary(windows: DataFrame) -> DataFrame:
    """Accepted windows per clip, and in all on the row whose clip is NULL."""
    return windows.rollup("clip").agg(F.count("*").alias("windows"))


def split_counts(df: DataFrame, subject: str, part: str = "part") -> DataFrame:
    """Rows and distinct subjects of each part."""
    return df.groupBy(part).agg(F.count("*").alias("rows"), F.countDistinct(subject).alias("subjects"))

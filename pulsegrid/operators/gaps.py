"""Missing-data intervals of irregular series, in closed form with window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.operators.intervals import overlapping


def time_steps(samples: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """Adds ``dt``, the time since the key's previous sample."""
    return samples.withColumn("dt", F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))


def median_step(samples: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """Median time step for each key (the mean of the middle two for an even number)."""
    return time_steps(samples, keys, order).groupBy(*keys).agg(F.median("dt").alias("median_dt"))


def broken_intervals(samples: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Broken intervals (clip, region, start_t, end_t) of samples (clip, region, t, valid).

    A run of invalid samples lasts from its first to the valid sample that ends it (or the last sample);
    where none is invalid, a hole of over ``gap_factor`` median steps lasts from one median step after
    the sample before it. Keys with fewer than two samples have no intervals. One shuffle on the key serves
    everything.
    """
    keys = ["clip", "region"]
    ordered = Window.partitionBy(*keys).orderBy("t")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    rows = samples.withColumn("prev", F.lag("t").over(ordered)).withColumn("grp", F.coalesce(F.sum(F.col("valid").cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("median_dt", F.median(F.col("t") - F.col("prev")).over(whole)).withColumn("last_t", F.max("t").over(whole)).withColumn("n", F.count("*").over(whole))
    groups = rows.filter("n >= 2").groupBy(*keys, "grp").agg(
        F.min(F.when(~F.col("valid"), F.col("t"))).alias("first_bad"),
        F.max(F.when(F.col("valid"), F.col("t"))).alias("closing"),
        F.max(F.when(F.col("valid"), F.col("prev"))).alias("prev"),
        F.first("median_dt").alias("median_dt"),
        F.first("last_t").alias("last_t"),
    )
    hole = F.col("first_bad").isNull() & (F.col("closing") - F.col("prev") > config.gap_factor * F.col("median_dt"))
    start = F.when(F.col("first_bad").isNotNull(), F.col("first_bad")).when(hole, F.col("prev") + F.col("median_dt"))
    return groups.withColumn("start_t", start).withColumn("end_t", F.coalesce("closing", "last_t")).filter("start_t IS NOT NULL").select(*keys, "start_t", "end_t")


def overlaps(windows: DataFrame, intervals: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each window's strictly positive overlaps with its clip's intervals, clipped to the window.

    ``windows`` has clip, w_start, w_end. Windows meet the intervals of the time cells that they reach, not all of their clip's.
    """
    joined = overlapping(windows, intervals, ["clip"], left_range=("w_start", "w_end"), right_range=("start_t", "end_t"), width=config.step_s)
    return joined.withColumn("o_start", F.greatest("w_start", "start_t")).withColumn("o_end", F.least("w_end", "end_t")).drop("start_t", "end_t")


def gate(windows: DataFrame, intervals: DataFrame, regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per window and region of its clip: longest and total broken time and whether the region passes; per window below ``accepted``.

    ``regions`` has clip, region.
    """
    broken = overlaps(windows, intervals, config).groupBy("clip", "region", "w_start").agg(F.max(F.col("o_end") - F.col("o_start")).alias("longest"), F.sum(F.col("o_end") - F.col("o_start")).alias("total"))
    every = windows.join(regions, "clip").join(broken, ["clip", "region", "w_start"], "left").fillna(0.0, ["longest", "total"])
    return every.withColumn("region_valid", (F.col("longest") <= config.max_gap_s) & (F.col("total") <= config.max_total_gap_s))


def accepted(gated: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Windows with enough valid regions."""
    per = gated.groupBy("clip", "w_start", "w_end").agg(F.count_if("region_valid").alias("valid_regions"), F.count("*").alias("regions"))
    return per.withColumn("accepted", F.col("valid_regions") >= F.least(F.lit(config.min_valid_regions), F.col("regions")))

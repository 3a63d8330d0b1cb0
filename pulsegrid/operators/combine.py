"""Region signals: validity, gates, count smoothing and weighted means over regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config

CHANNELS = ("r", "g", "b")


def finite(name: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(name).isNotNull() & ~F.isnan(name)


def missing_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN as NULL: the form in which everything downstream expects missing values."""
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def region_valid(df: DataFrame) -> DataFrame:
    """Adds ``valid``: all three channels are there."""
    return df.withColumn("valid", F.coalesce(finite("r") & finite("g") & finite("b"), F.lit(False)))


def frame_validity(regions: DataFrame) -> DataFrame:
    """Per clip: frames, and the share in which any region is valid."""
    frames = regions.groupBy("clip", "frame_idx").agg(F.bool_or("valid").alias("any_valid"))
    return frames.groupBy("clip").agg(F.count("*").alias("frames"), F.avg(F.col("any_valid").cast("double")).alias("valid_share"))


def gate_by_count(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Colours only where a region has enough pixels; the count stays."""
    return df.withColumns({c: F.when(F.col("pixel_count") >= config.min_pixels, F.col(c)) for c in CHANNELS})


def smooth_counts(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds ``weight``: a centred moving sum of counts over ``count_smooth_s`` (its constant divisor cancels in the mean).

    Series that are shorter than the filter keep their counts.
    """
    width = round(config.count_smooth_s * config.fps)
    key = ["clip", "region"]
    around = Window.partitionBy(*key).orderBy("frame_idx").rowsBetween(-(width // 2), (width - 1) // 2)
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("weight", F.when((n >= width) & F.lit(width >= 2), F.sum("pixel_count").over(around)).otherwise(F.col("pixel_count")).cast("double"))


def combine_regions(df: DataFrame, config: Config = DEFAULT, *, weighted: bool = True) -> DataFrame:
    """One colour per frame: the mean over regions, weighted by smoothed counts or plain over those that are there.

    With weights, a missing colour counts as 0 and keeps its weight (``missing_weight`` tells how much of it); frames
    without any weight are NULL.
    """
    if not weighted:
        return df.groupBy("clip", "frame_idx").agg(*[F.avg(c).alias(c) for c in CHANNELS])
    rows = smooth_counts(df, config)
    total = F.sum("weight")
    means = [F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("weight")), F.when(total != 0, total)).alias(c) for c in CHANNELS]
    lost = F.try_divide(F.sum(F.when(F.col("g").isNull(), F.col("weight")).otherwise(0.0)), F.when(total != 0, total)).alias("missing_weight")
    return rows.groupBy("clip", "frame_idx").agg(*means, lost)


def clear_rejected(samples: DataFrame) -> DataFrame:
    """Rejected regions of packed samples: no colours, counts 0."""
    def one(x: Column) -> Column:
        empty = F.lit(None).cast("array<float>")
        colours = [F.when(x["valid"], x[c]).otherwise(empty).alias(c) for c in CHANNELS]
        return F.struct(x["name"].alias("name"), x["valid"].alias("valid"), *colours, F.when(x["valid"], x["px"]).otherwise(F.transform(x["px"], lambda v: F.lit(0).cast("float"))).alias("px"))

    return samples.withColumn("regions", F.transform("regions", one))

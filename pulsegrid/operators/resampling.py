"""Uniform grids: duplicate times, linear interpolation, and PCHIP per clip and region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions.resample import pchip
from pulsegrid.operators.intervals import points_inside


def collapse_duplicates(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: the values' mean, NULL where any of the equal times misses the value."""
    return df.groupBy(*keys).agg(*[F.when(F.count("*") == F.count(v), F.avg(v)).alias(v) for v in values])


def uniform_grid(windows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every window's grid times (k, t), ``abs_start`` being its start."""
    return windows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(config.samples - 1)))).withColumn("t", F.col("abs_start") + F.col("k") / F.lit(config.fps))


def interpolate_linear(samples: DataFrame, grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` at the grid's times: linear between neighbours, the end values outside.

    Samples and grid points are sorted together once per key; the last sample before and the first after
    come from two running windows, so no row meets more than its neighbours.
    """
    both = samples.select(*keys, "t", F.col(value).cast("double").alias("v"), F.col("t").alias("at"), F.lit(False).alias("wanted"))
    both = both.unionByName(grid.select(*keys, "t", F.lit(None).cast("double").alias("v"), F.lit(None).cast("double").alias("at"), F.lit(True).alias("wanted")))
    order = Window.partitionBy(*keys).orderBy("t", "wanted")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy("t", F.desc("wanted")).rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumn("v0", F.last("v", True).over(before)).withColumn("t0", F.last("at", True).over(before))
    rows = rows.withColumn("v1", F.first("v", True).over(after)).withColumn("t1", F.first("at", True).over(after)).filter("wanted")
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * F.try_divide(F.col("t") - F.col("t0"), F.col("t1") - F.col("t0"))
    return rows.select(*keys, "t", F.coalesce(F.when(F.col("t1") > F.col("t0"), between), "v0", "v1").alias(value))


REGION = "segment string, name string, valid boolean, r array<float>, g array<float>, b array<float>, px array<float>"


def _one_region(rows: dict[str, np.ndarray], config: Config) -> tuple:
    """One window's samples of one region, in order of time, on the window's grid."""
    start, valid = float(rows["abs_start"][0]), bool(rows["valid"][0])
    out = start + np.arange(config.samples) / config.fps
    counts = np.interp(out, rows["t"], rows["pixel_count"]).astype(np.float32)
    colours = pchip(rows["t"], np.stack([rows["r"], rows["g"], rows["b"]], 1), out, config.support_slack) if valid else None
    return valid, *([None] * 3 if colours is None else colours.astype(np.float32).T), counts if valid else counts * 0


def resample(samples: DataFrame, windows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Packed samples of each window: colours by PCHIP (NULL where their support misses an end), counts linear.

    ``samples``: clip, region, t, r, g, b, pixel_count; ``windows``: as find_windows gives them, with a region_mask in the
    order of ``config.regions``. Samples find their windows by time cells; then a window's samples of a region follow each other in a
    sorted stream, and a task goes through many of them in one call, holding one (and a batch) at a time.
    """
    w = windows.select("segment", "clip", "abs_start", F.posexplode("region_mask").alias("at", "valid")).withColumn("region", F.element_at(F.array(*map(F.lit, config.regions)), F.col("at") + 1)).drop("at")
    w = w.withColumn("abs_end", F.col("abs_start") + config.window_s)
    rows = samples.select("clip", "region", F.col("t").cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("r", "g", "b", "pixel_count")])
    inside = points_inside(w, rows, ["clip", "region"], start="abs_start", end="abs_end", at="t", width=config.step_s)
    numbers = ["abs_start", "valid", "t", "r", "g", "b", "pixel_count"]
    inside = inside.select("segment", "region", *numbers).repartition("segment").sortWithinPartitions("segment", "region", "t", "r", "g", "b", "pixel_count")
    names = [f.split()[0] for f in REGION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []  # the last region's samples so far: a batch may end amid them

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.bool_(), *[pa.list_(pa.float32())] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def closed() -> tuple:
            return *held, *_one_region({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(numbers)}, config)

        for batch in batches:
            key = [pc.fill_null(batch.column(i), "").to_numpy(zero_copy_only=False) for i in (0, 1)]
            values = [batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(numbers))]
            edges = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
            out = []
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                if held != (own := (key[0][a], key[1][a])):
                    if held is not None:
                        out.append(closed())
                    held, parts = own, []
                parts.append([v[a:b] for v in values])
            if out:
                yield packed(out)
        if held is not None:
            yield packed([closed()])

    regions = inside.mapInArrow(run, REGION)
    packed = regions.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("name", "valid", "r", "g", "b", "px"))).alias("regions"))
    return packed.select("segment", F.lit(config.fps).cast("float").alias("fps"), "regions")

"""From decoded frames, parse masks and landmarks to region signals: one clip is one ordered group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions.regions import region_masks, region_means, skin_mask
from pulsegrid.functions.smoothing import OneEuro
from pulsegrid.schema import REGION_SIGNAL


def aligned(images: DataFrame, masks: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Frames that all three sides have, up to each clip's first gap (a failed read ends a clip)."""
    both = images.join(masks.select("clip", "frame_idx", "cls"), ["clip", "frame_idx"]).join(landmarks, ["clip", "frame_idx"])
    held = both.groupBy("clip").agg(F.array_sort(F.collect_set("frame_idx")).alias("at"))
    # the contiguous prefix: as many positions as hold their own index
    prefix = held.select("clip", F.size(F.filter("at", lambda x, i: x == i)).alias("n"))
    return both.join(prefix, "clip").filter(F.col("frame_idx") < F.col("n")).drop("n")


def skip_report(*sides: tuple[str, DataFrame]) -> DataFrame:
    """Clips that a side lacks: (clip, missing)."""
    every = None
    for _, df in sides:
        own = df.select("clip")
        every = own if every is None else every.union(own)
    every = every.distinct()
    out = None
    for name, df in sides:
        gone = every.join(df.select("clip").distinct(), "clip", "left_anti").withColumn("missing", F.lit(name))
        out = gone if out is None else out.union(gone)
    return out


def region_signals(frames: DataFrame, config: Config = DEFAULT, fps: float | None = None) -> DataFrame:
    """Region colours of aligned frames (clip, frame_idx, t, h, w, bgr, cls, pts).

    Landmarks are smoothed with a reset where a frame has none; skin masks without resets. Clips are hashed to partitions
    and their frames pass in order, an Arrow batch at a time: only the smoothers' state is carried on, so a clip of any
    length needs no more memory than a batch (``spark.sql.execution.arrow.maxRecordsPerBatch`` frames: set it by their size).
    """
    rate = fps or config.fps
    names = [c.split()[0] for c in REGION_SIGNAL.split(", ")]

    def of_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, points, skin = None, OneEuro(rate, config), OneEuro(rate, config)
        for rows in batches:
            out = []
            for row in rows.itertuples():
                if row.clip != clip:
                    clip, points, skin = row.clip, OneEuro(rate, config), OneEuro(rate, config)
                shape = (row.h, row.w)
                mask = skin.step(skin_mask(np.frombuffer(row.cls, np.uint8).reshape(shape)) / 255.0) >= config.mask_threshold
                raw = None if row.pts is None else np.array([[p["x"], p["y"]] for p in row.pts], float)
                if raw is None or not np.isfinite(raw).all():
                    points.reset()
                    found = [(None, None, None, 0)] * len(config.regions)
                else:
                    masks = region_masks(shape, points.step(raw), np.where(mask, 255, 0).astype(np.uint8), config)
                    found = region_means(np.frombuffer(row.bgr, np.uint8).reshape(*shape, 3), masks, config)
                out += [(row.clip, row.frame_idx, row.t, name, *values) for name, values in zip(config.regions, found, strict=True)]
            yield pd.DataFrame(out, columns=names)

    return frames.repartition("clip").sortWithinPartitions("clip", "frame_idx").mapInPandas(of_frames, REGION_SIGNAL)

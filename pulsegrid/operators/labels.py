"""Labels and keys: choosing, filtering and joining them; names taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config


def hr_label(measured: str = "ppg_hr", stated: str = "pulse") -> Column:
    """The measured heart rate, else the stated one; empty text counts as missing."""
    value = lambda c: F.expr(f"try_cast(nullif(trim(cast(`{c}` as string)), '') as double)")
    return F.coalesce(value(measured), value(stated))


def in_range(c: Column, low: float, high: float) -> Column:
    """Present, finite, and within inclusive bounds."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & c.between(low, high), F.lit(False))


def hr_rows(manifest: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows with a heart rate label in range, as ``hr``."""
    return manifest.withColumn("hr", hr_label()).filter(in_range(F.col("hr"), config.hr_min, config.hr_max))


def hb_rows(manifest: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows with a hemoglobin label in range, as ``hb``."""
    return manifest.withColumn("hb", F.expr("try_cast(hemoglobin as double)")).filter(in_range(F.col("hb"), config.hb_min, config.hb_max))


def both_rows(manifest: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows with both labels in range."""
    return hb_rows(hr_rows(manifest, config), config)


def present(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a partner, and those without (the skip report)."""
    return left.join(right, keys, "left_semi"), left.join(right, keys, "left_anti")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the last: later rows overwrite earlier ones."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_at = 1").drop("_at")


def base_name(c: str) -> Column:
    """File name without folders and its last extension, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.trim(c), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def clip_part(c: str, i: int, least: int = 3) -> Column:
    """Part i (from 0) of an underscore-separated clip name with at least ``least`` parts, else NULL."""
    parts = F.split(c, "_")
    return F.when(F.size(parts) >= least, F.get(parts, F.lit(i)))


def subject_of(clip: str, segment: str) -> Column:
    """Leading digits of the clip's name, or of the segment's where the clip has none; '?' without digits."""
    name = F.coalesce(F.expr(f"nullif(`{clip}`, '')"), F.col(segment))
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^([0-9]+)", 1), F.lit("")), F.lit("?"))


def frame_rate(text: str) -> Column:
    """Frames per second from 'num/den' text; NULL for other text or a zero denominator."""
    parts = F.split(text, "/")
    part = lambda i: F.try_to_number(F.trim(F.get(parts, F.lit(i))), F.lit("999999999D999999")).cast("double")
    return F.when(F.size(parts) == 2, F.try_divide(part(0), part(1)))


def frames_per_second(n: str, given_s: str, wall_s: str, header: str, default: float = 30.0) -> Column:
    """Counted frames over the given duration, else over the recorded one, else the header's rate, else the default."""
    over = lambda s: F.when((F.col(s) > 0) & (F.col(n) > 0), F.col(n) / F.col(s))
    return F.coalesce(over(given_s), over(wall_s), F.col(header), F.lit(default))


def manifest(windows: DataFrame, truth: DataFrame, ppg: DataFrame | None = None) -> DataFrame:
    """Windows with ground truth by clip and pulse recordings by (subject, state) of the clip's name, left outer.

    ``truth``: clip, patient_id, pulse, hemoglobin; ``ppg``: subject, state, ppg_file, ppg_sampling_frequency. The order
    of rows is (clip, index).
    """
    out = windows.join(truth, "clip", "left").withColumn("subject", clip_part("clip", 0)).withColumn("state", clip_part("clip", 2))
    if ppg is not None:
        out = out.join(ppg, ["subject", "state"], "left")
    return out.orderBy("clip", "index")

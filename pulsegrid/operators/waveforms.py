"""Array columns through the signal kernels: Arrow batches in, one NumPy call per batch and series length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import dsp


def by_length(series: pd.Series, kernel: Callable[[np.ndarray], np.ndarray]) -> list:
    """A kernel over rows of equal length at once; NULL rows stay NULL."""
    out: list = [None] * len(series)
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(series):
        if v is not None:
            groups.setdefault(len(v), []).append(i)
    for at in groups.values():
        result = kernel(np.stack([np.asarray(series.iloc[i], float) for i in at]))
        for i, r in zip(at, result, strict=True):
            out[i] = r
    return out


def bandpassed(c: str | Column, fps: float = DEFAULT.fps, config: Config = DEFAULT) -> Column:
    """Detrended, band-passed series."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(by_length(s, lambda x: dsp.bandpass(x, fps, config)))

    return run(c)


def detrended(c: str | Column, config: Config = DEFAULT) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(by_length(s, lambda x: dsp.detrend(x, config.detrend_lambda)))

    return run(c)


def heart_rate(c: str | Column, fps: float = DEFAULT.fps, config: Config = DEFAULT) -> Column:
    """STRUCT(hr, conf) of a series; hr is NULL where there is none."""

    @F.pandas_udf("hr double, conf double")
    def run(s: pd.Series) -> pd.DataFrame:
        pairs = by_length(s, lambda x: np.stack(dsp.spectral_hr(x, fps, config), 1))
        rows = [(None, None) if p is None else (None if np.isnan(p[0]) else float(p[0]), float(p[1])) for p in pairs]
        return pd.DataFrame(rows, columns=["hr", "conf"])

    return run(c)


def method_waveforms(r: str, g: str, b: str, fps: float = DEFAULT.fps, config: Config = DEFAULT) -> Column:
    """STRUCT of waveform, hr and conf for POS, CHROM and green, from three equally long colour series."""
    schema = ", ".join(f"{m} struct<waveform:array<double>,hr:double,conf:double>" for m in dsp.WAVES)

    @F.pandas_udf(schema)
    def run(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        joined = pd.Series([None if x is None or y is None or z is None else np.stack([x, y, z], 1) for x, y, z in zip(r, g, b, strict=True)])
        out = {}
        for name, wave in dsp.WAVES.items():
            waves = by_length(joined, lambda x, wave=wave: wave(x, fps, config))
            rates = by_length(pd.Series(waves), lambda x: np.stack(dsp.spectral_hr(x, fps, config), 1))
            out[name] = [None if w is None else {"waveform": w, "hr": None if np.isnan(p[0]) else float(p[0]), "conf": float(p[1])} for w, p in zip(waves, rates, strict=True)]
        return pd.DataFrame(out)

    return run(r, g, b)


def spectrum(df: DataFrame, key: str, series: str, fps: float, size: int, config: Config = DEFAULT) -> DataFrame:
    """In-band power (key, bin, freq, power) of array series as a DFT in expressions: samples meet a fixed table of bins.

    The bins are a bounded table (``size`` / 2 at most), exploded beside each sample; nothing but sums is shuffled.
    """
    n = F.size(series)
    rows = df.filter(n > 0).withColumn("_m", F.aggregate(series, F.lit(0.0), lambda s, x: s + x.cast("double")) / n).select(key, n.alias("_n"), "_m", F.posexplode(series).alias("_i", "_x"))
    hann = F.lit(0.5) - F.lit(0.5) * F.cos(2 * F.lit(np.pi) * F.col("_i") / (F.col("_n") - 1))
    rows = rows.withColumn("_v", (F.col("_x").cast("double") - F.col("_m")) * hann)
    low, high = int(np.ceil(config.hr_lo_hz * size / fps - 1e-9)), int(np.floor(config.hr_hi_hz * size / fps + 1e-9))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.lit(low), F.lit(high))))
    angle = 2 * F.lit(np.pi) * F.col("bin") * F.col("_i") / size
    sums = rows.groupBy(key, "bin").agg(F.sum(F.col("_v") * F.cos(angle)).alias("_c"), F.sum(F.col("_v") * F.sin(angle)).alias("_s"))
    return sums.select(key, "bin", (F.col("bin") * F.lit(fps / size)).alias("freq"), (F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")).alias("power"))


def peaks(power: DataFrame, key: str) -> DataFrame:
    """Heart rate and confidence from in-band power: the lowest of the highest bins, over the median."""
    top = F.min_by("freq", F.struct(-F.col("power"), F.col("bin")))
    return power.groupBy(key).agg((top * 60).alias("hr"), (F.max("power") / (F.median("power") + 1e-12)).alias("conf"))


def z_normalised(series: str) -> Column:
    """(x - mean) / (population deviation + 1e-9), in expressions."""
    n = F.size(series)
    mean = F.aggregate(series, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    var = F.aggregate(series, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / n - mean * mean
    return F.when(n > 0, F.transform(series, lambda x: (x.cast("double") - mean) / (F.sqrt(F.greatest(var, F.lit(0.0))) + 1e-9)))

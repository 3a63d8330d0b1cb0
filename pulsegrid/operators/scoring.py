"""From packed samples and the manifest to the result rows: heart rates of three methods, labels and model predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import dsp
from pulsegrid.operators.labels import hr_label
from pulsegrid.operators.learning import Model, predict, sample_arrays
from pulsegrid.schema import RESULT


def face_colours(colours: np.ndarray, counts: np.ndarray, config: Config = DEFAULT) -> np.ndarray:
    """(B, R, T, 3) and (B, R, T) -> (B, T, 3): the mean over regions, weighted by counts smoothed over ``count_smooth_s``.

    A missing colour counts as 0 and keeps its weight; frames without any weight are NaN.
    """
    width, t = round(config.count_smooth_s * config.fps), counts.shape[-1]
    weights = counts
    if 2 <= width <= t:
        total = np.concatenate([np.zeros((*counts.shape[:-1], 1)), counts.cumsum(-1)], -1)
        at = np.arange(t)
        weights = total[..., np.minimum(at + (width - 1) // 2 + 1, t)] - total[..., np.maximum(at - width // 2, 0)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (np.nan_to_num(colours) * weights[..., None]).sum(1) / weights.sum(1)[..., None]


def method_rates(regions: str = "regions", config: Config = DEFAULT) -> Column:
    """STRUCT of hr_* and conf_* of POS, CHROM and green on a sample's combined colour; rates without a peak are NULL."""
    names = [f"{k}_{m}" for m in dsp.WAVES for k in ("hr", "conf")]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(s: pd.Series) -> pd.DataFrame:
        parts = []
        for at in range(0, len(s), 256):
            face = face_colours(*sample_arrays(s.iloc[at : at + 256], config), config)
            columns = [dsp.spectral_hr(wave(face, config.fps, config), config.fps, config) for wave in dsp.WAVES.values()]
            parts.append(np.stack([c for pair in columns for c in pair], 1))
        values = np.concatenate(parts) if parts else np.zeros((0, len(names)))
        return pd.DataFrame({n: [None if np.isnan(v) else float(v) for v in values[:, i]] for i, n in enumerate(names)}, dtype=object)

    return run(regions)


def results(samples: DataFrame, manifest: DataFrame, *, hr_model: Model | None = None, hb_model: Model | None = None, config: Config = DEFAULT) -> DataFrame:
    """The 15 columns of the result rows, one for each window of the manifest that has a sample.

    ``samples``: segment, regions; ``manifest``: segment, clip, t_start, t_end, ppg_hr, pulse, hemoglobin. The measured heart rate goes before the
    stated one. Predictions of models that aren't given are NULL. Windows without a sample are left out (``labels.present`` tells which).
    """
    label = F.expr("try_cast(nullif(trim(cast(hemoglobin as string)), '') as double)")
    rows = manifest.select("segment", "clip", "t_start", "t_end", hr_label().alias("hr_label"), label.alias("hb_label")).join(samples.select("segment", "regions"), "segment")
    rows = rows.withColumn("_rates", method_rates(config=config))
    for model in (hr_model, hb_model):
        if model is not None:
            out = {"hr": ["hr_pred", "hr_pred_conf"], "hb": ["hb_pred"], "both": ["hr_pred", "hr_pred_conf", "hb_pred"]}[model.kind]
            told = predict(rows.drop(*out), model, config)
            rows = told.select(*[c for c in rows.columns if c not in out], *out)
    fields = [f.split() for f in RESULT.split(", ")]
    own = lambda c: F.col(c) if c in rows.columns else F.col(f"_rates.{c}") if c.startswith(("hr_", "conf_")) and c.split("_")[1] in dsp.WAVES else F.lit(None)
    return rows.select(*[own(c).cast(t).alias(c) for c, t in fields])

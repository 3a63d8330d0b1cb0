"""One-Euro smoothing: an exponential filter whose cutoff follows the speed (Casiez, Roussel and Vogel, 2012)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pulsegrid.config import DEFAULT, Config


@dataclass
class OneEuro:
    """State of one filtered vector series. The speed is the norm over the last axis, so a vector shares one cutoff."""

    rate: float
    config: Config = DEFAULT
    value: np.ndarray | None = None
    speed: np.ndarray | None = None

    def _gain(self, cutoff):
        return 1.0 / (1.0 + self.rate / (2 * np.pi * cutoff))

    def reset(self) -> None:
        self.value = self.speed = None

    def step(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if self.value is None:
            self.value, self.speed = x.copy(), np.zeros_like(x)
            return x.copy()
        c = self.config
        g = self._gain(c.euro_d_cutoff)
        self.speed = g * (x - self.value) * self.rate + (1 - g) * self.speed
        cutoff = c.euro_min_cutoff + c.euro_beta * np.linalg.norm(self.speed, axis=-1, keepdims=True)
        a = self._gain(cutoff)
        self.value = a * x + (1 - a) * self.value
        return self.value.copy()


def smooth_series(points: np.ndarray, rate: float, config: Config = DEFAULT) -> np.ndarray:
    """(T, ..., D) in order; missing frames (any NaN) reset the filter and stay missing."""
    out, f = np.full(points.shape, np.nan), OneEuro(rate, config)
    for k, x in enumerate(points):
        if np.isfinite(x).all():
            out[k] = f.step(x)
        else:
            f.reset()
    return out


def smooth_masks(masks: np.ndarray, rate: float, config: Config = DEFAULT) -> np.ndarray:
    """(T, H, W) masks of 0 and 255, smoothed without resets and cut at the threshold."""
    f = OneEuro(rate, config)
    return np.stack([np.where(f.step(m / 255.0) >= config.mask_threshold, 255, 0).astype(np.uint8) for m in masks]) if len(masks) else masks

"""Signal kernels on batches of equal-length series (rows of a 2-d array); missing values are NaN.

They are called once per Arrow batch, never per row.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log2, tan

import numpy as np

from pulsegrid.config import DEFAULT, Config


@lru_cache(maxsize=32)
def detrend_operator(n: int, lam: float) -> np.ndarray:
    """Smoothness priors: what takes a series of n samples to its deviation from a smooth trend."""
    if n < 5:
        return np.eye(n) - np.full((n, n), 1.0 / max(n, 1))
    d2 = np.diff(np.eye(n), 2, axis=0)
    return np.eye(n) - np.linalg.inv(np.eye(n) + lam**2 * d2.T @ d2)


def detrend(x: np.ndarray, lam: float = DEFAULT.detrend_lambda) -> np.ndarray:
    return x @ detrend_operator(x.shape[1], lam).T


@lru_cache(maxsize=32)
def butterworth(order: int, low: float, high: float, fps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Band-pass coefficients b, a and the filter's state for a constant input; None for an invalid band."""
    w1, w2 = low / (fps / 2), min(high / (fps / 2), 0.99)
    if not 0 < w1 < w2 < 1:
        return None
    edges = [4 * tan(np.pi * w / 2) for w in (w1, w2)]
    width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
    proto = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order)) * width / 2
    root = np.sqrt(proto**2 - centre**2)
    poles = np.concatenate([proto + root, proto - root])
    z_poles = (4 + poles) / (4 - poles)
    gain = width**order * np.real(4.0**order / np.prod(4 - poles))
    b = np.real(gain * np.poly(np.concatenate([np.ones(order), -np.ones(order)])))
    a = np.real(np.poly(z_poles))
    companion = np.zeros((2 * order, 2 * order))
    companion[0] = -a[1:]
    companion[1:, :-1] = np.eye(2 * order - 1)
    return b, a, np.linalg.solve(np.eye(2 * order) - companion.T, b[1:] - a[1:] * b[0])


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed over time, all rows at once."""
    out = np.empty_like(x)
    for k in range(x.shape[1]):
        y = b[0] * x[:, k] + state[:, 0]
        state[:, :-1] = state[:, 1:] + x[:, k, None] * b[1:-1] - y[:, None] * a[1:-1]
        state[:, -1] = x[:, k] * b[-1] - y * a[-1]
        out[:, k] = y
    return out


def bandpass(x: np.ndarray, fps: float, config: Config = DEFAULT, *, trend: bool = True) -> np.ndarray:
    """Zero-phase Butterworth band-pass; series no longer than the padding, or an invalid band, are only centred."""
    x = np.asarray(x, float)
    if x.shape[1] == 0:
        return x
    if trend:
        x = detrend(x, config.detrend_lambda)
    made = butterworth(config.filter_order, config.hr_lo_hz, config.hr_hi_hz, fps)
    pad = 3 * (2 * config.filter_order + 1)
    if made is None or x.shape[1] <= pad:
        return x - x.mean(1, keepdims=True)
    b, a, zi = made
    head, tail = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = np.concatenate([head, x, tail], 1)
    for _ in range(2):
        y = _filter(b, a, y, zi * y[:, :1])[:, ::-1]
    return y[:, pad:-pad]


def spectral_hr(x: np.ndarray, fps: float, config: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Heart rates in BPM (NaN where there is none) and confidences (peak over median power in the band, else 0)."""
    x = np.asarray(x, float)
    rows, n = x.shape
    rate, confidence = np.full(rows, np.nan), np.zeros(rows)
    if n < ceil(fps / config.hr_lo_hz):
        return rate, confidence
    ok = np.isfinite(x).all(1)
    ok[ok] = x[ok].std(1) >= 1e-9
    if not ok.any():
        return rate, confidence
    size = 1 << ceil(log2(4 * n))
    centred = (x[ok] - x[ok].mean(1, keepdims=True)) * np.hanning(n)
    power = np.abs(np.fft.rfft(centred, size, axis=1)) ** 2
    freq = np.fft.rfftfreq(size, 1 / fps)
    band = (freq >= config.hr_lo_hz) & (freq <= config.hr_hi_hz)
    if not band.any():
        return rate, confidence
    inside = power[:, band]
    peak = inside.argmax(1)  # the lowest of equal peaks
    rate[ok] = freq[band][peak] * 60
    middle = np.median(inside, 1)
    confidence[ok] = inside[np.arange(len(peak)), peak] / (middle + 1e-12)
    return rate, confidence


def pos_wave(rgb: np.ndarray, fps: float, config: Config = DEFAULT) -> np.ndarray:
    """Plane-orthogonal-to-skin pulse of (rows, T, 3): projected sliding windows, overlapped and added, then filtered."""
    rows, n, _ = rgb.shape
    width = round(config.pos_window_s * fps)
    pulse = np.zeros((rows, n))
    if n >= width:
        for at in range(n - width + 1):
            part = rgb[:, at : at + width]
            scaled = part / (part.mean(1, keepdims=True) + 1e-9)
            s1 = scaled[..., 1] - scaled[..., 2]
            s2 = scaled[..., 1] + scaled[..., 2] - 2 * scaled[..., 0]
            h = s1 + s1.std(1, keepdims=True) / (s2.std(1, keepdims=True) + 1e-9) * s2
            pulse[:, at : at + width] += h - h.mean(1, keepdims=True)
    return bandpass(pulse, fps, config)


def chrom_wave(rgb: np.ndarray, fps: float, config: Config = DEFAULT) -> np.ndarray:
    """Chrominance pulse of (rows, T, 3)."""
    scaled = rgb / (rgb.mean(1, keepdims=True) + 1e-9)
    x = 3 * scaled[..., 0] - 2 * scaled[..., 1]
    y = 1.5 * scaled[..., 0] + scaled[..., 1] - 1.5 * scaled[..., 2]
    xf, yf = bandpass(x, fps, config), bandpass(y, fps, config)
    return xf - xf.std(1, keepdims=True) / (yf.std(1, keepdims=True) + 1e-9) * yf


def green_wave(rgb: np.ndarray, fps: float, config: Config = DEFAULT) -> np.ndarray:
    return bandpass(rgb[..., 1], fps, config)


WAVES = {"pos": pos_wave, "chrom": chrom_wave, "green": green_wave}


def ac_dc(x: np.ndarray, fps: float, config: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Level and pulsatile amplitude of each row: mean, and deviation of the band-passed row (0 for a flat one).

    Rows that are wholly missing give zeros; partly missing ones are an error.
    """
    x = np.asarray(x, float)
    dc, ac = np.zeros(len(x)), np.zeros(len(x))
    there = np.isfinite(x)
    full = there.all(1)
    if (there.any(1) & ~full).any():
        raise ValueError("a series is partly missing")
    dc[full] = x[full].mean(1)
    lively = full.copy()
    lively[full] = x[full].std(1) >= 1e-9
    if lively.any():
        ac[lively] = bandpass(x[lively], fps, config).std(1)
    return dc, np.where(np.isfinite(ac), ac, 0.0)


def safe_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where either isn't finite or |b| is under 1e-9."""
    ok = np.isfinite(a) & np.isfinite(b) & (np.abs(b) >= 1e-9)
    return np.divide(a, b, out=np.zeros_like(np.asarray(a, float)), where=ok)

"""Shape-preserving cubic interpolation (Fritsch and Butland, 1984) on NumPy arrays."""

from __future__ import annotations

import numpy as np


def _slopes(h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Derivatives at the nodes from step widths (n-1,) and secants (n-1, C)."""
    d = np.zeros((len(h) + 1, m.shape[1]))
    if len(h) == 1:
        d[:] = m[0]
        return d
    left, right = m[:-1], m[1:]
    w1, w2 = (2 * h[1:] + h[:-1])[:, None], (h[1:] + 2 * h[:-1])[:, None]
    same = left * right > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        d[1:-1] = np.where(same, (w1 + w2) / (w1 / left + w2 / right), 0.0)
    for end, (h0, h1, m0, m1) in ((0, (h[0], h[1], m[0], m[1])), (-1, (h[-1], h[-2], m[-1], m[-2]))):
        edge = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        edge = np.where(np.sign(edge) != np.sign(m0), 0.0, edge)
        steep = (np.sign(m0) != np.sign(m1)) & (np.abs(edge) > 3 * np.abs(m0))
        d[end] = np.where(steep, 3 * m0, edge)
    return d


def pchip(t: np.ndarray, x: np.ndarray, out: np.ndarray, slack: float = 1.5) -> np.ndarray | None:
    """Columns of x (n, C) at times ``out``; None with under two complete samples, or where they end
    over ``slack`` median steps inside of ``out``'s ends. Equal times are averaged first."""
    keep = np.isfinite(x).all(1) & np.isfinite(t)
    t, x = t[keep], x[keep]
    if len(t) and (np.diff(t) <= 0).any():
        t, group = np.unique(t, return_inverse=True)
        n = np.bincount(group)
        x = np.stack([np.bincount(group, c) / n for c in x.T], 1)
    if len(t) < 2:
        return None
    room = slack * float(np.median(np.diff(t)))
    if t[0] - out[0] > room or out[-1] - t[-1] > room:
        return None
    at = np.clip(out, t[0], t[-1])
    h = np.diff(t)
    m = np.diff(x, axis=0) / h[:, None]
    d = _slopes(h, m)
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(h) - 1)
    s = ((at - t[k]) / h[k])[:, None]
    w = h[k][:, None]
    return (1 + 2 * s) * (1 - s) ** 2 * x[k] + s * (1 - s) ** 2 * w * d[k] + s**2 * (3 - 2 * s) * x[k + 1] + s**2 * (s - 1) * w * d[k + 1]

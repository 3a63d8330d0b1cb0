"""Face regions on pixel grids: hulls of landmarks, skin, erosion."""

from __future__ import annotations

import numpy as np

from pulsegrid.config import DEFAULT, Config

# Landmark indices of each region (478-point face mesh) and the face-parsing class of skin.
POLYGONS = {
    "forehead": (67, 109, 10, 338, 297, 299, 337, 151, 108, 69, 104, 9),
    "lcheek": (116, 117, 118, 119, 100, 142, 36, 205, 187, 123, 50, 101, 147, 213, 192, 214, 135, 138),
    "rcheek": (345, 346, 347, 348, 329, 371, 266, 425, 411, 352, 280, 330, 376, 433, 416, 434, 364, 367),
}
SKIN_CLASSES = (1,)
SUBPIXEL = 8


def skin_mask(classes: np.ndarray) -> np.ndarray:
    """255 where a pixel's class is skin, else 0."""
    return np.where(np.isin(classes, SKIN_CLASSES), 255, 0).astype(np.uint8)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def fill_hull(shape: tuple[int, int], points: np.ndarray) -> np.ndarray:
    """255 on pixels whose centre lies in the hull of the points, which are rounded to eighths of a pixel."""
    hull = convex_hull(np.round(points * SUBPIXEL) / SUBPIXEL)
    if len(hull) < 3:
        return np.zeros(shape, np.uint8)
    y, x = np.mgrid[: shape[0], : shape[1]]
    inside = np.ones(shape, bool)
    for a, b in zip(hull, np.roll(hull, -1, 0), strict=True):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    return np.where(inside, 255, 0).astype(np.uint8)


def erode(mask: np.ndarray, px: int) -> np.ndarray:
    """Minimum over a square of 2 * px + 1 pixels; pixels outside of the image don't count. 0: unchanged."""
    if px <= 0:
        return mask
    for axis in (0, 1):
        pad = [(px, px) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(mask, pad, constant_values=255)
        mask = np.lib.stride_tricks.sliding_window_view(wide, 2 * px + 1, axis).min(-1)
    return mask


def region_masks(shape: tuple[int, int], landmarks: np.ndarray, skin: np.ndarray, config: Config = DEFAULT) -> np.ndarray:
    """(R, H, W): each region's hull on skin, eroded."""
    return np.stack([erode(fill_hull(shape, landmarks[list(POLYGONS[r]), :2]) & skin, config.erosion_px) for r in config.regions])


def region_means(bgr: np.ndarray, masks: np.ndarray, config: Config = DEFAULT) -> list[tuple[float | None, float | None, float | None, int]]:
    """(r, g, b, count) per region; no colours under the least number of pixels."""
    out = []
    for m in masks:
        on = m > 0
        n = int(on.sum())
        b, g, r = bgr[on].astype(float).mean(0) if n >= config.min_pixels else (None, None, None)
        out.append((r, g, b, n))
    return out

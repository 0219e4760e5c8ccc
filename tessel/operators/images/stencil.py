"""Neighbourhood filters: an image is one row, so they are numpy shifts inside a task and nothing is shuffled.

The ``*_array`` functions take one gray image or a stack of them (image x row x column).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import map_images


def _shifted(a: np.ndarray, kernel: np.ndarray, mode: str = "constant") -> np.ndarray:
    """Correlation of gray images with an odd kernel."""
    k, m = kernel.shape
    p = np.pad(a, ((0, 0),) * (a.ndim - 2) + ((k // 2, k // 2), (m // 2, m // 2)), mode=mode)
    h, w = a.shape[-2:]
    return sum(kernel[y, x] * p[..., y : y + h, x : x + w] for y in range(k) for x in range(m) if kernel[y, x])


def _byte(a: np.ndarray) -> np.ndarray:
    return np.floor(np.round(np.clip(a, 0, 255), 9))


_CROSS = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)


def laplacian_array(a: np.ndarray) -> np.ndarray:
    return _byte(_shifted(a, _CROSS))


def laplacian(images: DataFrame) -> DataFrame:
    """Zero border, clipped to 0..255."""
    return map_images(images, laplacian_array)


def abs_laplacian(images: DataFrame) -> DataFrame:
    """Mirrored border, absolute value, at most 255."""
    return map_images(images, lambda a: np.minimum(np.abs(_shifted(a, _CROSS, "reflect")), 255))


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    r = np.arange(size) - size // 2
    k = np.exp(-(r[:, None] ** 2 + r[None] ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def gaussian_array(a: np.ndarray, size: int, sigma: float) -> np.ndarray:
    return _byte(_shifted(a, gaussian_kernel(size, sigma)))


def gaussian_blur(images: DataFrame, size: int = 3, sigma: float = 1.3) -> DataFrame:
    """Zero border, kernel sums to 1, clipped and truncated."""
    return map_images(images, lambda a: gaussian_array(a, size, sigma))


_SOBEL_V = np.array([[1, 2, 1], [0, 0, 0], [-1, -2, -1]], float)


def sobel_array(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertical, horizontal), each clipped to 0..255: falling edges only."""
    return _byte(_shifted(a, _SOBEL_V)), _byte(_shifted(a, _SOBEL_V.T))


def sobel(images: DataFrame) -> DataFrame:
    """Two channels: vertical, horizontal."""
    return map_images(images, lambda a: np.stack(sobel_array(a), axis=-1))


def edge_strength(fx: Column, fy: Column) -> Column:
    return F.least(F.lit(255.0), F.sqrt(fx * fx + fy * fy))


def edge_angle(fx: Column, fy: Column) -> Column:
    return F.atan(fy / F.greatest(fx, F.lit(1e-10)))


def quantize_angle(angle: Column) -> Column:
    """0, 45, 90 or 135 from radians; below -22.5 degrees 180 is added; above 157.5 it is 0."""
    d = angle / 3.141592653589793 * 180
    d = F.round(F.when(d < -22.5, d + 180).otherwise(d), 9)
    return F.when(d <= 22.5, 0).when(d <= 67.5, 45).when(d <= 112.5, 90).when(d <= 157.5, 135).otherwise(0)


def strength_and_band(fy: np.ndarray, fx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.minimum(np.sqrt(fx**2 + fy**2), 255)
    d = np.degrees(np.arctan(fy / np.maximum(fx, 1e-10)))
    d = np.round(np.where(d < -22.5, d + 180, d), 9)
    return edge, np.select([d <= 22.5, d <= 67.5, d <= 112.5, d <= 157.5], [0, 45, 90, 135], 0)


#: Band -> the two neighbours' (dy, dx).
_ALONG = {0: ((0, -1), (0, 1)), 45: ((1, -1), (-1, 1)), 90: ((-1, 0), (1, 0)), 135: ((-1, -1), (1, 1))}


def suppress_array(edge: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Zero where a neighbour along the band is larger. At the border the step that leaves the image is dropped on that axis alone."""
    h, w = edge.shape[-2:]
    y, x = np.mgrid[:h, :w]
    out = edge.copy()
    for b, steps in _ALONG.items():
        top = np.max([edge[..., np.clip(y + dy, 0, h - 1), np.clip(x + dx, 0, w - 1)] for dy, dx in steps], axis=0)
        out[(band == b) & (top > edge)] = 0
    return out


def non_max_suppress(images: DataFrame) -> DataFrame:
    """Two-channel images (strength, band) to one channel."""
    return map_images(images, lambda a: suppress_array(a[..., 0], a[..., 1]), "double")


def _beside(m: np.ndarray) -> np.ndarray:
    """True where a place of the row above or below is, straight or one aside."""
    out = m.copy()
    out[..., 1:] |= m[..., :-1]
    out[..., :-1] |= m[..., 1:]
    return out


def hysteresis_array(edge: np.ndarray, high: float = 100, low: float = 30) -> np.ndarray:
    """One raster pass, in place: an undecided pixel becomes 255 if a neighbour, as it stands by then, reaches ``high``.

    By then the row above is final, this row and the one below hold first values
    right of the pixel; so a row needs no walk: undecided pixels beside those are
    raised, and a raised or strong one raises the run of undecided ones on its right.
    """
    e = np.where(edge >= high, 255, np.where(edge <= low, 0, edge))
    strong = e >= high
    undecided = (e > 0) & ~strong
    h, w = e.shape[-2:]
    place = np.arange(w)
    out = np.zeros(e.shape)
    above = np.zeros(e[..., 0, :].shape, bool)
    for y in range(h):
        now, may = strong[..., y, :], undecided[..., y, :]
        near = _beside(above)
        if y + 1 < h:
            near |= _beside(strong[..., y + 1, :])
        near[..., :-1] |= now[..., 1:]
        lit = np.maximum.accumulate(np.where(now | (may & near), place, -1), axis=-1)
        wall = np.maximum.accumulate(np.where(now | may, -1, place), axis=-1)
        above = lit > wall
        out[..., y, :] = np.where(above, 255, 0)
    return out


def hysteresis(images: DataFrame, high: float = 100, low: float = 30) -> DataFrame:
    return map_images(images, lambda a: hysteresis_array(a, high, low))


def canny_array(a: np.ndarray, size: int = 5, sigma: float = 1.4, high: float = 100, low: float = 30) -> np.ndarray:
    """Of a stack (image x row x column [x channel])."""
    gray = np.floor(np.round(a[..., 2] * 0.2126 + a[..., 1] * 0.7152 + a[..., 0] * 0.0722, 9)) if a.ndim == 4 else a
    fy, fx = sobel_array(gaussian_array(gray, size, sigma))
    edge, band = strength_and_band(fy, fx)
    return hysteresis_array(suppress_array(edge, band), high, low)


def canny(images: DataFrame, size: int = 5, sigma: float = 1.4, high: float = 100, low: float = 30) -> DataFrame:
    """Gray, blur, Sobel, strength and band, suppression and hysteresis in one pass over the image rows."""
    return map_images(images, lambda a: canny_array(a, size, sigma, high, low))

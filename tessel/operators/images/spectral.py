"""Two-dimensional Fourier transform and low-pass filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import grid_rows, map_images, rows_of_stacks


def waves(n: int) -> np.ndarray:
    """The matrix of the transform of length n."""
    k = np.arange(n)
    return np.exp(-2j * np.pi * (np.outer(k, k) % n) / n)


def transform(a: np.ndarray) -> np.ndarray:
    """The transform of one image or of a stack of them: two matrix products."""
    return waves(a.shape[-2]) @ a @ waves(a.shape[-1])


def inverse(f: np.ndarray) -> np.ndarray:
    return waves(f.shape[-2]).conj() @ f @ waves(f.shape[-1]).conj() / (f.shape[-2] * f.shape[-1])


def dft2d(images: DataFrame, scaled: bool = False) -> DataFrame:
    """(image_id, u, v, re, im) of gray images; ``scaled`` divides by the root of the pixel count."""

    def run(a: np.ndarray) -> tuple[np.ndarray, ...]:
        f = transform(a) / (np.sqrt(a[0].size) if scaled else 1)
        return grid_rows(f.real, f.imag)

    return rows_of_stacks(images, run, "u int, v int, re double, im double")


def _scale(a: np.ndarray) -> np.ndarray:
    """Each image of a stack from its smallest value to its largest, as 0..255; all zeros where they are equal."""
    a = np.round(a, 9)
    low = a.min((-2, -1), keepdims=True)
    span = a.max((-2, -1), keepdims=True) - low
    return np.floor(np.round((a - low) / np.where(span, span, 1) * 255, 6))


def idft2d(images: DataFrame, scaled: bool = False) -> DataFrame:
    """Inverse of two-channel images (re, im): the real part scaled to 0..255; ``scaled``: the absolute value of the scaled transform, clipped."""

    def back(a: np.ndarray) -> np.ndarray:
        f = inverse(a[..., 0] + 1j * a[..., 1])
        return np.floor(np.round(np.clip(np.abs(f) * np.sqrt(f[0].size), 0, 255), 6)) if scaled else _scale(f.real)

    return map_images(images, back)


def quadrant_shift(spectrum: DataFrame, height: int, width: int) -> DataFrame:
    """Swap quadrants diagonally; even sizes only."""
    if height % 2 or width % 2:
        raise ValueError("quadrants of odd sizes don't match")
    return spectrum.withColumns({"u": ((F.col("u") + height // 2) % height), "v": ((F.col("v") + width // 2) % width)})


def low_pass_array(a: np.ndarray, by_ratio: float | None = None) -> np.ndarray:
    """Of one image or of a stack of them."""
    h, w = a.shape[-2:]
    y, x = np.mgrid[:h, :w]
    far = np.sqrt((y - h // 2) ** 2 + (x - w // 2) ** 2)
    keep = far <= (h // 4 if by_ratio is None else w // 2 * by_ratio)
    back = inverse(transform(a) * np.roll(keep, (-(h // 2), -(w // 2)), (0, 1)))
    return _scale(back.real) if by_ratio is None else np.floor(np.round(np.clip(np.abs(back), 0, 255), 6))


def low_pass(images: DataFrame, by_ratio: float | None = None) -> DataFrame:
    """Keep the disc of a quarter of the height around the centre of the spectrum (or ``by_ratio`` of half the width) and transform back."""
    return map_images(images, lambda a: low_pass_array(a, by_ratio))


def log_spectrum(spectrum: DataFrame) -> DataFrame:
    return spectrum.withColumn("log_abs", F.log(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) + 1))

"""Histograms of oriented gradients, in two variants.

A: border gradients 0, half-open bins (180 degrees falls into bin 0), cells
divided by the root of their neighbourhood's plain sum. B: edge padding, a zero
x gradient becomes 1e-6, closed bins (the later one wins), cells divided in
place by the root of the sum of squares, so that earlier cells count as already
divided.

An image is one row: stacks of equal-sized images go through numpy together, and no
pixel is shuffled or sorted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import grid_rows, rows_of_stacks


def gradient_stack(a: np.ndarray, variant: str = "A") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gx, gy, magnitude, angle in 0..180 degrees) of a stack of gray images."""
    if variant == "A":
        gx, gy = np.zeros_like(a), np.zeros_like(a)
        gx[:, 1:-1, 1:-1], gy[:, 1:-1, 1:-1] = a[:, 1:-1, 2:] - a[:, 1:-1, :-2], a[:, 2:, 1:-1] - a[:, :-2, 1:-1]
        ang = np.degrees(np.arctan2(gy, gx))
    else:
        p = np.pad(a, ((0, 0), (1, 1), (1, 1)), "edge")
        gx, gy = p[:, 1:-1, 2:] - p[:, 1:-1, :-2], p[:, 2:, 1:-1] - p[:, :-2, 1:-1]
        gx = np.where(gx == 0, 1e-6, gx)
        ang = np.degrees(np.arctan(gy / gx))
    return gx, gy, np.sqrt(gx * gx + gy * gy), np.round(np.where(ang < 0, ang + 180, ang), 9)


def bin_stack(ang: np.ndarray, variant: str = "A") -> np.ndarray:
    """Bin 0..8 of 20 degrees."""
    b = np.floor(ang / 20).astype(np.int32)
    return np.where((b < 0) | (b > 8), 0, b).astype(np.int32) if variant == "A" else np.clip(b, 0, 8)


def histogram_stack(a: np.ndarray, cell: int = 8, variant: str = "A") -> np.ndarray:
    """Image x cell row x cell column x bin: magnitudes summed; the ragged border is left out."""
    _, _, mag, ang = gradient_stack(a, variant)
    n, (ny, nx) = len(a), (s // cell for s in a.shape[1:])
    cut = lambda v: v[:, : ny * cell, : nx * cell]
    mag, b = cut(mag), cut(bin_stack(ang, variant))
    return np.stack([np.where(b == k, mag, 0.0).reshape(n, ny, cell, nx, cell).sum((2, 4)) for k in range(9)], axis=-1)


def normalize_stack(hist: np.ndarray, variant: str = "A") -> np.ndarray:
    """Cells divided by the root of their 3 x 3 neighbourhood's sum (A) or sum of squares as it stands at that moment (B), plus 1."""
    ny, nx = hist.shape[1:3]
    if variant == "A":
        t = np.pad(hist.sum(-1), ((0, 0), (1, 1), (1, 1)))
        return hist / np.sqrt(sum(t[:, dy : dy + ny, dx : dx + nx] for dy in range(3) for dx in range(3)) + 1)[..., None]
    hist = hist.copy()
    for y in range(ny):  # cells in raster order, all images at once
        for x in range(nx):
            near = hist[:, max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2]
            hist[:, y, x] /= np.sqrt((near**2).sum((1, 2, 3)) + 1)[:, None]
    return hist


def gradients(images: DataFrame, variant: str = "A") -> DataFrame:
    """(image_id, y, x, gx, gy, mag, ang) of gray images; ang in degrees of 0..180."""
    return rows_of_stacks(images, lambda a: grid_rows(*gradient_stack(a, variant)), "y int, x int, gx double, gy double, mag double, ang double")


def orientations(images: DataFrame, variants: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """(image_id, y, x, one bin per variant: bin_a, bin_b)."""
    return rows_of_stacks(images, lambda a: grid_rows(*[bin_stack(gradient_stack(a, v)[3], v) for v in variants]), "y int, x int, " + ", ".join(f"bin_{v.lower()} int" for v in variants))


def quantize_orientation(ang: Column, variant: str = "A") -> Column:
    """Bin 0..8 of 20 degrees, of a column of angles."""
    b = F.floor(ang / 20).cast("int")
    return F.when((b < 0) | (b > 8), 0).otherwise(b) if variant == "A" else F.least(F.lit(8), F.greatest(F.lit(0), b))


def cell_histogram(images: DataFrame, cell: int = 8, variant: str = "A") -> DataFrame:
    """(image_id, cy, cx, bin, m): magnitudes summed per cell and bin."""
    return rows_of_stacks(images, lambda a: grid_rows(histogram_stack(a, cell, variant)), "cy int, cx int, bin int, m double")


def bin_edges_histogram(values: DataFrame, value: str, weight: str, edges: list[float]) -> DataFrame:
    """(bin, m): one cell's form with explicit edges; a value on an edge belongs to the bin it opens."""
    b = F.lit(-1)
    for k, e in enumerate(edges):
        b = F.when(F.col(value) >= e, k).otherwise(b)
    return values.groupBy(b.alias("bin")).agg(F.sum(weight).alias("m")).where(F.col("bin").between(0, len(edges) - 2))


def hog(images: DataFrame, variant: str = "A", cell: int = 8) -> DataFrame:
    """(image_id, cy, cx, bin, m) of gray images: the feature vector in long form."""
    return rows_of_stacks(images, lambda a: grid_rows(normalize_stack(histogram_stack(a, cell, variant), variant)), "cy int, cx int, bin int, m double")

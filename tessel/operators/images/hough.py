"""Line detection by Hough votes.

An image is one row, and so is its accumulator: rho x 180 counts. Peaks are found by
comparing the accumulator with shifted views of itself and lines are drawn where it
stands, so a search through all steps shuffles nothing. Edges that come as pixels give
partial accumulators of each task, which are summed per image in one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import rows_of_stacks

#: Cosine and sine of 0..179 degrees, rounded to 12 places so that truncation is the same everywhere.
COS = np.array([round(math.cos(math.radians(t)), 12) for t in range(180)])
SIN = np.array([round(math.sin(math.radians(t)), 12) for t in range(180)])
HELD = 64  # accumulators a task keeps before it hands them on


def shift_of(height: int, width: int, round_up: bool = False) -> int:
    """What rho is shifted by: the diagonal, rounded down (or up)."""
    diagonal = math.sqrt(height**2 + width**2)
    return math.ceil(diagonal) if round_up else int(diagonal)


def _rho(y: np.ndarray, x: np.ndarray, shift: int) -> np.ndarray:
    return np.round(x[:, None] * COS + y[:, None] * SIN, 9).astype(np.int64) + shift


def accumulate(stack: np.ndarray, shift: int) -> np.ndarray:
    """Image x rho x angle: votes of the pixels that are 255; rho is truncated toward 0."""
    n, size = len(stack), 2 * shift + 2
    i, y, x = np.nonzero(stack == 255)
    out = np.zeros((n, size * 180), np.int64)
    for z in range(0, len(i), 65_536):
        cell = i[z : z + 65_536, None] * (size * 180) + _rho(y[z : z + 65_536], x[z : z + 65_536], shift) * 180 + np.arange(180)
        out += np.bincount(cell.ravel(), minlength=out.size).reshape(out.shape)
    return out.reshape(n, size, 180)


def peaks(votes: np.ndarray) -> np.ndarray:
    """Which cells no one of their upper, left and upper left neighbour exceeds; the first row and column and cells without votes are out."""
    on = np.zeros(votes.shape, bool)
    here = votes[:, 1:, 1:]
    on[:, 1:, 1:] = (here > 0) & (here >= votes[:, :-1, 1:]) & (here >= votes[:, 1:, :-1]) & (here >= votes[:, :-1, :-1])
    return on


def strongest(votes: np.ndarray, on: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(owner, rho, theta, votes, line) of the n strongest peaks per image; ties in raster order."""
    i, rho, theta = np.nonzero(on)
    v = votes[i, rho, theta]
    order = np.lexsort((theta, rho, -v, i))
    i, rho, theta, v = i[order], rho[order], theta[order], v[order]
    line = np.arange(len(i)) - np.searchsorted(i, i) + 1
    top = line <= n
    return i[top], rho[top].astype(np.int32), theta[top].astype(np.int32), v[top], line[top].astype(np.int32)


def drawn(owner: np.ndarray, rho: np.ndarray, theta: np.ndarray, n: int, height: int, width: int, shift: int) -> np.ndarray:
    """Image x row x column: the pixels on the lines: y from every x and x from every y, truncated, inside the image."""
    out = np.zeros((n, height, width), bool)
    c, s, r = COS[theta], SIN[theta], (rho - shift).astype(np.float64)
    for by_x in (True, False):
        a, b = (c, s) if by_x else (s, c)
        ok = b != 0
        k = np.arange(width if by_x else height)
        v = np.round(-(a[ok] / b[ok])[:, None] * k + (r[ok] / b[ok])[:, None], 9)
        inside = np.abs(v) < 2**31
        v = np.where(inside, v, -1).astype(np.int64)
        inside &= (v >= 0) & (v < (height if by_x else width))
        j, at = np.nonzero(inside)
        o, v = owner[ok][j], v[j, at]
        out[(o, v, k[at]) if by_x else (o, k[at], v)] = True
    return out


def _weight(h: int, w: int, c: int) -> int:
    """Numbers that an image and its accumulator take."""
    return 3 * (2 * shift_of(h, w) + 4) * 180 + h * w


def _modulo(votes: np.ndarray, wrap: bool) -> np.ndarray:
    return votes % 256 if wrap else votes


def hough_votes(images: DataFrame, round_up: bool = False, wrap: bool = False) -> DataFrame:
    """(image_id, rho, theta, votes) of gray images whose edges are 255; ``wrap`` takes the votes modulo 256."""

    def rows(stack: np.ndarray) -> tuple[np.ndarray, ...]:
        votes = accumulate(stack, shift_of(*stack.shape[1:], round_up))
        i, rho, theta = np.nonzero(votes)
        return i, rho.astype(np.int32), theta.astype(np.int32), _modulo(votes[i, rho, theta], wrap)

    return rows_of_stacks(images, rows, "rho int, theta int, votes long", _weight)


def hough_peaks(images: DataFrame, round_up: bool = False) -> DataFrame:
    """(image_id, rho, theta, votes) of the peaks."""

    def rows(stack: np.ndarray) -> tuple[np.ndarray, ...]:
        votes = accumulate(stack, shift_of(*stack.shape[1:], round_up))
        i, rho, theta = np.nonzero(peaks(votes))
        return i, rho.astype(np.int32), theta.astype(np.int32), votes[i, rho, theta]

    return rows_of_stacks(images, rows, "rho int, theta int, votes long", _weight)


def top_lines(images: DataFrame, n: int = 20, round_up: bool = False) -> DataFrame:
    """(image_id, rho, theta, votes, line) of the n strongest peaks of each image."""

    def rows(stack: np.ndarray) -> tuple[np.ndarray, ...]:
        votes = accumulate(stack, shift_of(*stack.shape[1:], round_up))
        return strongest(votes, peaks(votes), n)

    return rows_of_stacks(images, rows, "rho int, theta int, votes long, line int", _weight)


def draw_lines(images: DataFrame, n: int = 20, round_up: bool = False) -> DataFrame:
    """(image_id, y, x) of the pixels on each image's n strongest lines."""

    def rows(stack: np.ndarray) -> tuple[np.ndarray, ...]:
        h, w = stack.shape[1:]
        shift = shift_of(h, w, round_up)
        votes = accumulate(stack, shift)
        i, rho, theta, _, _ = strongest(votes, peaks(votes), n)
        o, y, x = np.nonzero(drawn(i, rho, theta, len(stack), h, w, shift))
        return o, y.astype(np.int32), x.astype(np.int32)

    return rows_of_stacks(images, rows, "y int, x int", _weight)


def pixel_votes(edges: DataFrame, height: int, width: int, round_up: bool = False) -> DataFrame:
    """(image_id, rho, theta, votes) of edges that come as pixels (image_id, y, x, v) in any order.

    A task sums the votes of up to HELD images at a time; partial accumulators of an
    image meet in one shuffle, so the pixels of a very large image may lie in any number of
    tasks.
    """
    shift = shift_of(height, width, round_up)
    size = (2 * shift + 2) * 180

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            i = [np.full(np.count_nonzero(v), k) for k, v in held.items()]
            at = [np.flatnonzero(v) for v in held.values()]
            n = [v[p] for v, p in zip(held.values(), at)]
            held.clear()
            join = lambda x: pa.array(np.concatenate(x).astype(np.int64))
            return pa.RecordBatch.from_arrays([join(i), join(at), join(n)], ["image_id", "cell", "n"])

        for b in batches:
            i, y, x = (b.column(c).to_numpy(zero_copy_only=False) for c in ("image_id", "y", "x"))
            for k in np.unique(i):
                if len(held) == HELD and k not in held:
                    yield rows()
                own = i == k
                cell = _rho(y[own], x[own], shift) * 180 + np.arange(180)
                held[k] = held.get(k, 0) + np.bincount(cell.ravel(), minlength=size)
        if held:
            yield rows()

    part = edges.where("v = 255").select("image_id", "y", "x").mapInArrow(run, "image_id long, cell long, n long")
    votes = part.groupBy("image_id", "cell").agg(F.sum("n").alias("votes"))
    return votes.select("image_id", F.expr("cast(cell div 180 as int)").alias("rho"), (F.col("cell") % 180).cast("int").alias("theta"), "votes")


def paint(pixels: DataFrame, on: DataFrame, value: int = 255) -> DataFrame:
    """The pixel table with the given pixels set."""
    return pixels.join(on.select("image_id", "y", "x", F.lit(True).alias("_on")), ["image_id", "y", "x"], "left").withColumn("v", F.when(F.col("_on"), value).otherwise(F.col("v"))).drop("_on")

"""Resizing, moving, searching."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_images, rows_of_stacks


MAX_TEMPLATE = 1_024  # pixels of a template that meets pixel tables


def resize_nearest(pixels: DataFrame, height: int, width: int, scale: float) -> DataFrame:
    """Target (y, x) takes the source int(y / scale), int(x / scale), inside the image. Each source pixel names its targets, so nothing is joined."""

    def targets(c: str, n: int):
        m, at = int(n * scale), F.col(c)
        near = F.sequence(F.floor(at * scale).cast("int") - 1, F.ceil((at + 1) * scale).cast("int") + 1)
        return F.explode(F.filter(near, lambda t: (t >= 0) & (t < m) & (F.least(F.lit(n - 1), F.floor(F.round(t / scale, 9)).cast("int")) == at)))

    return pixels.withColumn("y", targets("y", height)).withColumn("x", targets("x", width))


def bilinear_array(a: np.ndarray, scale: float, standard: bool = False) -> np.ndarray:
    """Four neighbours, inside the image. By default the two mixed terms have their weights swapped; ``standard`` gives the textbook weights. Truncated. Of a stack (image x row x column [x channel])."""
    h, w = a.shape[1:3]
    sy, sx = np.arange(int(h * scale)) / scale, np.arange(int(w * scale)) / scale
    y1, x1 = np.minimum(np.floor(np.round(sy, 9)).astype(int), h - 1), np.minimum(np.floor(np.round(sx, 9)).astype(int), w - 1)
    y2, x2 = np.minimum(y1 + 1, h - 1), np.minimum(x1 + 1, w - 1)
    dy, dx = (sy - y1)[:, None], (sx - x1)[None]
    if a.ndim == 4:
        dy, dx = dy[..., None], dx[..., None]
    at = lambda y, x: a[:, y[:, None], x]
    right, below = at(y1, x2), at(y2, x1)
    if not standard:
        right, below = below, right
    v = at(y1, x1) * (1 - dx) * (1 - dy) + right * dx * (1 - dy) + below * (1 - dx) * dy + at(y2, x2) * dx * dy
    return np.floor(np.round(v, 9))


def resize_bilinear(images: DataFrame, scale: float, standard: bool = False) -> DataFrame:
    return map_images(images, lambda a: bilinear_array(a, scale, standard))


def affine(pixels: DataFrame, height: int, width: int, tx: float, ty: float, angle: float) -> DataFrame:
    """Forward map of each pixel, truncated toward 0; pixels outside go, of several on one place the last in raster order stays; (image_id, y, x, v) without the holes."""
    c, s = round(math.cos(angle), 12), round(math.sin(angle), 12)
    to = lambda e: F.round(e, 9).cast("int")  # noqa: E731  a cast truncates
    x, y = to(F.col("x") * c - F.col("y") * s + tx), to(F.col("x") * s + F.col("y") * c + ty)
    moved = pixels.select("image_id", y.alias("ny"), x.alias("nx"), "v", F.struct("y", "x").alias("o")).where((F.col("nx") >= 0) & (F.col("nx") < width) & (F.col("ny") >= 0) & (F.col("ny") < height))
    return moved.groupBy("image_id", F.col("ny").alias("y"), F.col("nx").alias("x")).agg(F.max_by("v", "o").alias("v"))


def template_stack(a: np.ndarray, t: np.ndarray, inclusive: bool = False) -> tuple[np.ndarray, ...]:
    """(place in the stack, y, x, ssd) of the best offset of each image, none where the template doesn't fit.

    A sum of squared differences is sum(a^2) - 2 sum(a t) + sum(t^2): the first by
    a summed-area table, the second by a transform of the whole image. Memory does not
    grow with the template, nor with the offsets times its size. Offsets that these
    sums can't tell from the best one are compared by the differences themselves.
    """
    if a.ndim == 3:
        a, t = a[..., None], t[..., None]
    n, h, w, _ = a.shape
    n_y, n_x = h - t.shape[0] + inclusive, w - t.shape[1] + inclusive
    if n_y <= 0 or n_x <= 0:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int32, np.int32, float))
    area = np.zeros((n, h + 1, w + 1))
    np.cumsum(np.cumsum((a**2).sum(3), axis=1), axis=2, out=area[:, 1:, 1:])
    y, x = np.arange(n_y)[:, None], np.arange(n_x)
    y2, x2 = y + t.shape[0], x + t.shape[1]
    ssd = area[:, y2, x2] - area[:, y, x2] - area[:, y2, x] + area[:, y, x] + (t**2).sum()
    for c in range(a.shape[3]):
        both = np.fft.rfft2(a[..., c]) * np.fft.rfft2(t[..., c], (h, w)).conj()
        ssd -= 2 * np.fft.irfft2(both, (h, w))[:, :n_y, :n_x]
    blur = 1e-11 * (area[:, -1, -1] + (t**2).sum())
    owner, y, x = np.nonzero(ssd <= (ssd.min((1, 2)) + blur)[:, None, None])
    exact = np.empty(len(owner))
    windows = np.lib.stride_tricks.sliding_window_view(a, t.shape[:2], axis=(1, 2))
    step = max(1, 1_000_000 // t.size)
    for z in range(0, len(owner), step):
        some = slice(z, z + step)
        exact[some] = ((windows[owner[some], y[some], x[some]] - np.moveaxis(t, 2, 0)) ** 2).sum((1, 2, 3))
    best = np.lexsort((x, y, exact, owner))
    best = best[np.unique(owner[best], return_index=True)[1]]
    return owner[best], y[best].astype(np.int32), x[best].astype(np.int32), exact[best]


def template_match(images: DataFrame, template: np.ndarray, inclusive: bool = False) -> DataFrame:
    """(image_id, y, x, ssd): the offset of the smallest sum of squared differences, the first in raster order.

    As is customary here the last offset of each axis is left out; ``inclusive``
    takes it in. The template is one array and travels with the function.
    """
    t = np.asarray(template, float)
    return rows_of_stacks(images, lambda a: template_stack(a, t, inclusive), "y int, x int, ssd double", lambda h, w, c: 8 * h * w * (c + 2))


def template_match_pixels(pixels: DataFrame, template: DataFrame, height: int, width: int, t_height: int, t_width: int) -> DataFrame:
    """The same on pixel tables: the template (y, x, v), of MAX_TEMPLATE pixels at most, meets each pixel by offset."""
    t = template.select("y", "x", "v").limit(MAX_TEMPLATE + 1).collect()
    if len(t) > MAX_TEMPLATE:
        raise ValueError(f"a template of more than {MAX_TEMPLATE} pixels: use template_match")
    meets = F.array(*[F.struct(F.lit(r["y"]).alias("ty"), F.lit(r["x"]).alias("tx"), F.lit(r["v"]).alias("tv")) for r in t])
    at = pixels.select("image_id", "y", "x", "v", F.inline(meets)).select("image_id", (F.col("y") - F.col("ty")).alias("dy"), (F.col("x") - F.col("tx")).alias("dx"), F.pow(F.col("v") - F.col("tv"), 2).alias("d"))
    at = at.where((F.col("dy") >= 0) & (F.col("dx") >= 0) & (F.col("dy") < height - t_height) & (F.col("dx") < width - t_width))
    sums = at.groupBy("image_id", "dy", "dx").agg(F.sum("d").alias("ssd"))
    return sums.groupBy("image_id").agg(F.min_by(F.struct("dy", "dx", "ssd"), F.struct("ssd", "dy", "dx")).alias("b")).select("image_id", F.col("b.dy").alias("y"), F.col("b.dx").alias("x"), F.col("b.ssd").alias("ssd"))


def draw_box(pixels: DataFrame, boxes: DataFrame, t_height: int, t_width: int, value: int = 255) -> DataFrame:
    """Outline of the box whose corner (y, x) ``boxes`` gives per image; the far corner lies at + size."""
    b = boxes.select("image_id", F.col("y").alias("by"), F.col("x").alias("bx"))
    d = pixels.join(b, "image_id", "left")
    in_y = (F.col("y") >= F.col("by")) & (F.col("y") <= F.col("by") + t_height)
    in_x = (F.col("x") >= F.col("bx")) & (F.col("x") <= F.col("bx") + t_width)
    rim = (in_x & ((F.col("y") == F.col("by")) | (F.col("y") == F.col("by") + t_height))) | (in_y & ((F.col("x") == F.col("bx")) | (F.col("x") == F.col("bx") + t_width)))
    return d.withColumn("v", F.when(rim, value).otherwise(F.col("v"))).drop("by", "bx")

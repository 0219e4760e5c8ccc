"""Pixel-wise operators: expressions over pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ranking import draw, draw_number


def swap_channels(pixels: DataFrame) -> DataFrame:
    """BGR to RGB and back."""
    return pixels.select(*[F.col({"b": "r", "r": "b"}.get(c, c)).alias(c) for c in pixels.columns])


def channels_last(data: Column, channels: int, height: int, width: int) -> Column:
    """A flat channel x row x column array as row x column x channel."""
    n = height * width
    return F.transform(F.sequence(F.lit(0), F.lit(n * channels - 1)), lambda k: F.get(data, (k % channels) * n + (k / channels).cast("int")))


def gray_value(truncate: bool = False, library: bool = False) -> Column:
    """0.2126 R + 0.7152 G + 0.0722 B, or the library's 0.299 / 0.587 / 0.114; truncated to whole numbers on request."""
    wr, wg, wb = (0.299, 0.587, 0.114) if library else (0.2126, 0.7152, 0.0722)
    v = F.round(F.col("r") * wr + F.col("g") * wg + F.col("b") * wb, 9)
    return v.cast("int") if truncate else v


def grayscale(pixels: DataFrame, truncate: bool = False, library: bool = False) -> DataFrame:
    """(image_id, y, x, v) with :func:`gray_value`."""
    return pixels.select("image_id", "y", "x", gray_value(truncate, library).alias("v"))


def bgr_to_hsv(pixels: DataFrame) -> DataFrame:
    """h (degrees), s (largest - smallest) and v (largest) of channels in 0..1; the smallest channel decides the hue, in the order B, R, G."""
    b, g, r = (F.col(c) / 255 for c in "bgr")
    hi, lo = F.greatest(b, g, r), F.least(b, g, r)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(lo == b, 60 * (g - r) / d + 60).when(lo == r, 60 * (b - g) / d + 180).otherwise(60 * (r - b) / d + 300)
    return pixels.withColumns({"h": h, "s": d, "v": hi})


def hue_shift(pixels: DataFrame, by: float = 180.0) -> DataFrame:
    return pixels.withColumn("h", F.pmod(F.col("h") + by, F.lit(360.0)))


def hsv_to_rgb(pixels: DataFrame, gray_to_black: bool = False) -> DataFrame:
    """b, g, r (0..255, truncated) from h, s, v; a hue outside [0, 360) adds no chroma. ``gray_to_black``: pixels without chroma become 0."""
    h, c, m = F.col("h") / 60, F.col("s"), F.col("v") - F.col("s")
    x = c * (1 - F.abs(F.pmod(h, F.lit(2.0)) - 1))
    zero = F.lit(0.0)
    sectors = [(c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x)]

    def part(k: int) -> Column:
        e = F.when(F.lit(False), zero)
        for i, s in enumerate(sectors):
            e = e.when((h >= i) & (h < i + 1), s[k])
        v = F.least(F.lit(1.0), F.greatest(zero, e.otherwise(zero) + m))
        v = F.round(v * 255, 6).cast("int")
        return F.when(c == 0, 0).otherwise(v) if gray_to_black else v

    return pixels.withColumns({"r": part(0), "g": part(1), "b": part(2)})


def reduce_colors(pixels: DataFrame, cols: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    return pixels.withColumns({c: F.expr(f"cast(`{c}` div 64 * 64 + 32 as int)") for c in cols})


def color_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, channel, bin, n) of reduced colours, zeros filled: 12 rows an image. Channel 0 is the first stored one (B), though it is customarily shown as R."""
    red = reduce_colors(pixels)
    aggs = [F.count_if(F.expr(f"{c} div 64 = {b}")).alias(f"{c}{b}") for c in "bgr" for b in range(4)]
    wide = red.groupBy("image_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("channel"), F.lit(b).alias("bin"), F.col(f"{c}{b}").alias("n")) for k, c in enumerate("bgr") for b in range(4)])
    return wide.select("image_id", F.inline(rows))


def normalize_channels(pixels: DataFrame, mean: tuple[float, ...], std: tuple[float, ...]) -> DataFrame:
    """(v / 255 - mean) / std of r, g, b with given triples."""
    return pixels.withColumns({c: (F.col(c) / 255 - m) / s for c, m, s in zip("rgb", mean, std)})


def denormalize(pixels: DataFrame, mean: tuple[float, ...], std: tuple[float, ...]) -> DataFrame:
    """v * std + mean, clamped to 0..1."""
    return pixels.withColumns({c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) * s + m)) for c, m, s in zip("rgb", mean, std)})


def add_noise(pixels: DataFrame, factor: float, seed: int = 0) -> DataFrame:
    """v + factor * N(0, 1), the same for a pixel wherever it is computed (Box-Muller on md5 draws)."""
    u = lambda tag: (draw_number(draw(seed, F.lit(tag), "image_id", "y", "x")).cast("double") + 1) / float(16**15 + 1)
    return pixels.withColumn("v", F.col("v") + factor * F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * math.pi * u("b")))


def random_flip(pixels: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """Mirror an image's columns with probability one half."""
    flip = draw_number(draw(seed, F.lit("flip"), "image_id")) % 2 == 1
    return pixels.withColumn("x", F.when(flip, width - 1 - F.col("x")).otherwise(F.col("x")))


def random_crop(pixels: DataFrame, size: int = 32, pad: int = 4, seed: int = 42) -> DataFrame:
    """Pad whole ``size`` x ``size`` images by zeros and crop them to that size at a random offset: pixels move, those outside go, what is left empty is 0.

    Nothing is shuffled: each pixel moves by itself, and the one at the origin
    also brings the empty places of its image.
    """
    offset = lambda tag: (draw_number(draw(seed, F.lit(tag), "image_id")) % (2 * pad + 1) - pad).cast("int")
    outside = lambda e: (e < 0) | (e >= size)
    d = pixels.select("image_id", "y", "x", F.coalesce("v", F.lit(0)).alias("v"), offset("dy").alias("_dy"), offset("dx").alias("_dx"))
    cell = lambda y, x, v: F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), v.alias("v"))
    moved = F.filter(F.array(cell(F.col("y") - F.col("_dy"), F.col("x") - F.col("_dx"), F.col("v"))), lambda s: ~outside(s["y"]) & ~outside(s["x"]))
    none = F.lit(0).cast(d.schema["v"].dataType)
    places = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda p: cell(F.floor(p / size), p % size, none))
    empty = F.filter(places, lambda s: outside(s["y"] + F.col("_dy")) | outside(s["x"] + F.col("_dx")))
    return d.select("image_id", F.inline(F.when((F.col("y") == 0) & (F.col("x") == 0), F.concat(moved, empty)).otherwise(moved)))


def hsv_wheel(spark: SparkSession, size: int = 500) -> DataFrame:
    """(y, x, r, g, b in 0..1): hue by angle, value by radius, white outside the disc."""
    return paint_wheel(spark.range(size * size).select(F.expr(f"cast(id div {size} as int)").alias("y"), (F.col("id") % size).cast("int").alias("x")), size)


def paint_wheel(pixels: DataFrame, size: int) -> DataFrame:
    """The wheel's r, g, b at the places of a table of ``size`` x ``size`` images."""
    c = size // 2
    dx, dy = F.col("x") - c, F.col("y") - c
    dist = F.sqrt((dx * dx + dy * dy).cast("double"))
    h6 = F.round((F.atan2(dy.cast("double"), dx.cast("double")) + math.pi) / (2 * math.pi) * 6, 9)
    v = dist / c
    sector, f = F.pmod(F.floor(h6), F.lit(6)), h6 - F.floor(h6)
    zero = F.lit(0.0)
    q, t = v * (1 - f), v * f
    rows = [(v, t, zero), (q, v, zero), (zero, v, t), (zero, q, v), (t, zero, v), (v, zero, q)]

    def part(k: int) -> Column:
        e = F.when(dist > c, 1.0)
        for i, r in enumerate(rows):
            e = e.when(sector == i, r[k])
        return e

    return pixels.withColumns({"r": part(0), "g": part(1), "b": part(2)})


def minmax_scale(pixels: DataFrame, col: str = "v", top: float = 1.0, max_only: bool = False) -> DataFrame:
    """Scale to 0..top per image, from the smallest value or from 0; a flat image becomes 0."""
    w = W.partitionBy("image_id")
    lo = F.lit(0.0) if max_only else F.min(col).over(w)
    hi = F.max(col).over(w)
    return pixels.withColumn(col, F.coalesce((F.col(col) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)) * top)

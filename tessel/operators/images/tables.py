"""Image tables (one row an image) and pixel tables (one row a pixel)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_pixels(images: DataFrame) -> DataFrame:
    """(image_id, y, x, c, v) of row-major, channel-last data."""
    p = images.select("image_id", "width", "channels", F.posexplode("data").alias("p", "v"))
    return p.select("image_id", F.expr("cast(p div (width * channels) as int)").alias("y"), F.expr("cast(p div channels % width as int)").alias("x"), (F.col("p") % F.col("channels")).alias("c"), "v")


def wide_pixels(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, b, g, r) of a three-channel pixel table."""
    pick = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    return pixels.groupBy("image_id", "y", "x").agg(pick(0).alias("b"), pick(1).alias("g"), pick(2).alias("r"))


def wide_of_images(images: DataFrame) -> DataFrame:
    """(image_id, y, x, b, g, r) straight from an image table: no shuffle."""
    i = F.sequence(F.lit(0), F.expr("height * width - 1"))
    rows = F.transform(i, lambda k: F.struct(k.alias("k"), *[F.get("data", k * 3 + c).alias(n) for c, n in enumerate("bgr")]))
    p = images.where("channels = 3").select("image_id", "width", F.inline(rows))
    return p.select("image_id", F.expr("cast(k div width as int)").alias("y"), (F.col("k") % F.col("width")).alias("x"), "b", "g", "r")


def pack_pixels(pixels: DataFrame) -> DataFrame:
    """Image table of a pixel table (image_id, y, x, c, v)."""
    g = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.max("c") + 1).alias("channels"), F.sort_array(F.collect_list(F.struct("y", "x", "c", "v"))).alias("s"))
    return g.select("image_id", "height", "width", "channels", F.col("s.v").alias("data"))


def stacks(b: pa.RecordBatch, weight: Callable[[int, int, int], int], limit: int = 16_000_000) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(image ids, stack: image x row x column [x channel] of doubles) of the images of a batch, by size; ``weight`` tells how many numbers an image takes, ``limit`` are held at a time."""
    sizes = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width", "channels")], axis=1)
    for h, w, c in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (h, w, c)).all(1))
        step = max(1, limit // max(1, weight(int(h), int(w), int(c))))
        for z in range(0, len(at), step):
            own = pa.array(at[z : z + step])
            a = b.column("data").take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield b.column("image_id").take(own), a.reshape(len(own), h, w) if c == 1 else a.reshape(len(own), h, w, c)


def map_images(images: DataFrame, f: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> DataFrame:
    """Image table of ``f`` of stacks of equal-sized images: (image x row x column [x channel]) to the same form. An image is one row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, stack in stacks(b, lambda h, w, c: 12 * h * w * c):
                out = f(stack)
                n, h, w, c = *out.shape[:3], out.shape[3] if out.ndim == 4 else 1
                flat = pa.array(out.ravel() if kind == "double" else out.ravel().astype(np.int32))
                data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w * c)), flat)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.full(n, v, np.int32)) for v in (h, w, c)], data], ["image_id", "height", "width", "channels", "data"])

    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, f"image_id long, height int, width int, channels int, data array<{kind}>")


def rows_of_stacks(images: DataFrame, f: Callable[[np.ndarray], tuple[np.ndarray, ...]], schema: str, weight: Callable[[int, int, int], int] = lambda h, w, c: 12 * h * w * c) -> DataFrame:
    """(image_id, the columns of ``schema``): ``f`` of a stack gives (place of the image in the stack, columns), one entry per row. Nothing is shuffled."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, stack in stacks(b, weight):
                owner, *cols = f(stack)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), *[pa.array(c) for c in cols]], ["image_id", *names])

    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, f"image_id long, {schema}")


def grid_rows(*values: np.ndarray) -> tuple[np.ndarray, ...]:
    """For :func:`rows_of_stacks`: owner, the places along all further axes and the values of equally shaped stacks."""
    owner, *places = np.indices(values[0].shape, sparse=False)
    return (owner.ravel(), *[p.ravel().astype(np.int32) for p in places], *[v.ravel() for v in values])

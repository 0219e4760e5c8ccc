"""Generated tables: one row for each row of a table of keys; every number is a function of seed and key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import draw, draw_number


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1], from an md5 draw."""
    return (draw_number(draw(seed, *keys)).cast("double") + 1) / float(16**15)


def normal(seed: int, tag: str, *keys: Column | str) -> Column:
    """A standard normal number (Box and Muller)."""
    u, v = (uniform(seed, F.lit(f"{tag}{x}"), *keys) for x in "uv")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def make_blobs(keys: DataFrame, key: str, centers: list[list[float]] | int = 3, dims: int = 2, std: float = 3.0, seed: int = 10, box: float = 10.0) -> DataFrame:
    """(key, x0.., y): isotropic points around given centres, or so many random ones in a box."""
    if isinstance(centers, int):
        import numpy as np

        centers = np.random.default_rng(seed).uniform(-box, box, (centers, dims)).tolist()
    d = keys.select(key).withColumn("y", (draw_number(draw(seed, F.lit("y"), key)) % len(centers)).cast("int"))
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    return d.withColumns({f"x{j}": F.get(F.get(table, F.col("y")), F.lit(j)) + F.lit(float(std)) * normal(seed, f"x{j}", key) for j in range(len(centers[0]))})


def make_linear(keys: DataFrame, key: str, weights: list[float], bias: float = 0.0, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(key, feature_0.., target): target = X w + b + noise * N(0, 1)."""
    d = keys.select(key).withColumns({f"feature_{j}": normal(seed, f"f{j}", key) for j in range(len(weights))})
    y = sum((F.col(f"feature_{j}") * F.lit(float(w)) for j, w in enumerate(weights)), F.lit(float(bias)))
    return d.withColumn("target", y + F.lit(float(noise)) * normal(seed, "noise", key))


def make_random_images(keys: DataFrame, key: str, size: int = 32, channels: int = 3, classes: int = 3, seed: int = 0) -> DataFrame:
    """(image_id, image, label): channel x row x column values in [0, 1) as one array."""
    px = F.transform(F.sequence(F.lit(0), F.lit(size * size * channels - 1)), lambda i: draw_number(draw(seed, key, i)).cast("double") / float(16**15))
    return keys.select(F.col(key).alias("image_id"), px.alias("image"), (draw_number(draw(seed, F.lit("label"), key)) % classes).cast("int").alias("label"))

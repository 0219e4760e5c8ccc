"""Scaling and covariance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import moments


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column (``m_col``, ``s_col``)."""
    return df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])


def apply_scaler(df: DataFrame, model: DataFrame, cols: list[str], zero_to_one: bool = False) -> DataFrame:
    """(x - mean) / deviation; a zero deviation gives null, or divides by one with ``zero_to_one``."""
    d = df.crossJoin(F.broadcast(model))  # one row
    s = lambda c: F.when(F.col(f"s_{c}") == 0, 1.0 if zero_to_one else None).otherwise(F.col(f"s_{c}"))
    return d.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / s(c) for c in cols}).select(df.columns)


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; constant columns become 0."""
    return apply_scaler(df, fit_scaler(df, cols), cols, zero_to_one=True)


def normalize_const(df: DataFrame, means: dict[str, float], stds: dict[str, float]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - means[c]) / stds[c] for c in means})


def covariance_matrix(df: DataFrame, vector: str, dim: int) -> np.ndarray:
    """Sample covariance matrix of a column of arrays of ``dim`` numbers: one Gram matrix a task, summed in Spark.

    Nulls are left out pair by pair; a pair with fewer than two rows is NaN. The
    plan doesn't grow with ``dim``.
    """
    n, _, scatter = moments(df, vector, dim)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 1, scatter / (n - 1), np.nan)


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, cov): sample covariance of all column pairs, null where fewer than two rows hold both."""
    m = covariance_matrix(df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v")), "v", len(cols))
    rows = [(a, b, None if np.isnan(x) else float(x)) for a, line in zip(cols, m) for b, x in zip(cols, line)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, cov double")

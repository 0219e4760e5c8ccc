"""Linear regression from one-pass statistics: the loss and its gradient need only n, sums and cross products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    weights: list[float]
    bias: float
    losses: list[float]  # before each update


def linear_predict(df: DataFrame, cols: list[str], weights: list[float], bias: float, out: str = "pred") -> DataFrame:
    return df.withColumn(out, sum((F.col(c) * F.lit(float(w)) for c, w in zip(cols, weights)), F.lit(float(bias))))


def moments(df: DataFrame, cols: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y (a column of ones last), y'y and n, from one aggregate."""
    v = [*cols, y]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    r = df.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(v)], *[F.sum(F.col(v[i]) * F.col(v[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    d = len(cols)
    xx, xy = np.zeros((d + 1, d + 1)), np.zeros(d + 1)
    for i in range(d):
        for j in range(d):
            xx[i, j] = r[f"p{min(i, j)}_{max(i, j)}"]
        xx[i, d] = xx[d, i] = r[f"s{i}"]
        xy[i] = r[f"p{i}_{d}"]
    xx[d, d], xy[d] = r["n"], r[f"s{d}"]
    return xx, xy, float(r[f"p{d}_{d}"]), int(r["n"])


def fit_gd(df: DataFrame, cols: list[str], y: str, lr: float = 0.01, epochs: int = 1000, init: list[float] | None = None) -> Fit:
    """Full-batch gradient descent on the mean squared error; weights start at 0 (or ``init``, the bias last)."""
    xx, xy, yy, n = moments(df, cols, y)
    w, losses = np.array(init or [0.0] * (len(cols) + 1), float), []
    for _ in range(epochs):
        losses.append(float((w @ xx @ w - 2 * w @ xy + yy) / n))
        w = w - lr * 2 * (xx @ w - xy) / n
    return Fit(w[:-1].tolist(), float(w[-1]), losses)


def fit_adam(df: DataFrame, cols: list[str], y: str, lr: float = 0.01, epochs: int = 500, init: list[float] | None = None) -> Fit:
    """The same with Adam's steps (0.9, 0.999, 1e-8)."""
    xx, xy, yy, n = moments(df, cols, y)
    w, losses = np.array(init or [0.0] * (len(cols) + 1), float), []
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        losses.append(float((w @ xx @ w - 2 * w @ xy + yy) / n))
        g = 2 * (xx @ w - xy) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Fit(w[:-1].tolist(), float(w[-1]), losses)


def loss_history(df: DataFrame, fitted: Fit, every: int = 100) -> DataFrame:
    """(epoch, loss), 1-based, every ``every`` epochs."""
    return df.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(fitted.losses) if (i + 1) % every == 0], "epoch int, loss double")


def evaluate_linear(df: DataFrame, cols: list[str], y: str, fitted: Fit, true_weights: list[float], true_bias: float) -> DataFrame:
    """(name, learned, expected) of each weight and the bias, with the table's mean squared error."""
    from .metrics import mse

    error = mse(linear_predict(df, cols, fitted.weights, fitted.bias), y, "pred")
    rows = [(f"w_{c}", w, t) for c, w, t in zip(cols, fitted.weights, true_weights)] + [("bias", fitted.bias, true_bias)]
    return df.sparkSession.createDataFrame(rows, "name string, learned double, expected double").crossJoin(F.broadcast(error))

"""Network scoring and data-parallel training."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import CHUNK, SCHEMA, task_rows, task_sums

Layers = list[tuple[np.ndarray, np.ndarray]]  # (out x in weights, out biases) of each dense layer


def dense(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Affine layer as array expressions, for narrow layers."""
    rows = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a.cast("double") * b), F.lit(float(b)), lambda s, v: s + v) for row, b in zip(weights, bias)]
    return F.array(*rows)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def flatten_channels(x: Column) -> Column:
    """Channel x row x column to one vector."""
    return F.flatten(F.flatten(x))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(x: Column) -> Column:
    """Index of the largest value, the first on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def init_layers(sizes: list[int], seed: int = 0) -> Layers:
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (o, i)) / np.sqrt(i), rng.uniform(-1, 1, o) / np.sqrt(i)) for i, o in zip(sizes, sizes[1:])]


def forward(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w.T + b
        out.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
    return out


def _matrix(p: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in p]) if len(p) else np.zeros((0, 0))


def score_mlp(df: DataFrame, features: str, layers: Layers, out: str = "logits") -> DataFrame:
    """Add the outputs of a dense-ReLU stack; weights travel once per executor, numpy multiplies whole batches."""
    shared = df.sparkSession.sparkContext.broadcast(layers)
    schema = df.select("*", F.array(F.lit(0.0)).alias(out)).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            if len(p):
                p[out] = list(forward(_matrix(p[features]), shared.value)[-1])
                yield p

    return df.mapInPandas(run, schema)


def conv_block(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """3x3 convolution with a border of zeros, ReLU and 2x2 maximum; x is batch x channel x row x column."""
    n, c, h, wd = x.shape
    pad = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    cols = np.stack([pad[:, :, dy : dy + h, dx : dx + wd] for dy in range(3) for dx in range(3)], axis=2)
    z = np.einsum("nckhw,ock->nohw", cols, w.reshape(len(w), c, 9), optimize=True) + b[None, :, None, None]
    z = np.maximum(z, 0)[:, :, : h // 2 * 2, : wd // 2 * 2]
    return z.reshape(n, len(w), h // 2, 2, wd // 2, 2).max(axis=(3, 5))


def score_cnn(df: DataFrame, image: str, shape: tuple[int, int, int], convs: Layers, denses: Layers, out: str = "logits", rows: int = 256) -> DataFrame:
    """Add a small convolutional network's outputs: blocks of :func:`conv_block`, then dense layers; dropout is off at scoring. ``rows`` images are held at a time."""
    shared = df.sparkSession.sparkContext.broadcast((convs, denses))
    schema = df.select("*", F.array(F.lit(0.0)).alias(out)).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cs, ds = shared.value
        for p in it:
            for a in range(0, len(p), rows):
                q = p.iloc[a : a + rows].copy()
                x = _matrix(q[image]).reshape(len(q), *shape)
                for w, b in cs:
                    x = conv_block(x, w, b)
                q[out] = list(forward(x.reshape(len(q), -1), ds)[-1])
                yield q

    return df.mapInPandas(run, schema)


def _gradient(x: np.ndarray, y: np.ndarray, layers: Layers, loss: str) -> tuple[float, np.ndarray]:
    """Summed loss and gradient (flat) of a batch."""
    acts = forward(x, layers)
    if loss == "mse":
        d = acts[-1] - y.reshape(len(y), -1).astype(float)
        total, d = float((d**2).sum()), 2 * d
    else:
        z = acts[-1] - acts[-1].max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        k = y.astype(int)
        total = float(-np.log(p[np.arange(len(k)), k]).sum())
        d = p
        d[np.arange(len(k)), k] -= 1
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads.append((d.T @ acts[i], d.sum(0)))
        if i:
            d = (d @ layers[i][0]) * (acts[i] > 0)
    return total, np.concatenate([np.concatenate([w.ravel(), b]) for w, b in grads[::-1]])


@dataclass
class _State:
    """Weights (flat) and what the optimiser carries from step to step."""

    flat: np.ndarray
    m: np.ndarray
    s: np.ndarray
    t: int = 0

    def step(self, g: np.ndarray, optimizer: str, lr: float) -> None:
        self.t += 1
        if optimizer == "adam":
            self.m, self.s = 0.9 * self.m + 0.1 * g, 0.999 * self.s + 0.001 * g * g
            self.flat = self.flat - lr * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.999**self.t)) + 1e-8)
        else:
            self.flat = self.flat - lr * g


def _unflat(v: np.ndarray, shapes: list[tuple[int, int]]) -> Layers:
    out, at = [], 0
    for o, i in shapes:
        out.append((v[at : at + o * i].reshape(o, i), v[at + o * i : at + o * i + o]))
        at += o * i + o
    return out


def _walk(shared, shapes: list[tuple[int, int]], loss: str, optimizer: str, lr: float):
    """Steps through the batches of a range, in order, and hands on (steps, sum of mean losses, sum of losses, rows, t) and the state."""

    def run(rows: pa.Table) -> pa.Table:
        state: _State = copy.deepcopy(shared.value)
        done = np.zeros(4)
        rows = rows.sort_by("b").combine_chunks()
        ids, y = rows.column("b").to_numpy(), rows.column("y").to_numpy()
        x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        cut = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for z, e in zip(cut, cut[1:]):
            lost, g = _gradient(x[z:e], y[z:e], _unflat(state.flat, shapes), loss)
            state.step(g / (e - z), optimizer, lr)
            done += (1, lost / (e - z), lost, e - z)
        return pa.Table.from_batches([task_rows(np.concatenate([done, [state.t], state.flat, state.m, state.s]))])

    return run


def train_mlp(df: DataFrame, features: str, target: str, layers: Layers, loss: str = "mse", optimizer: str = "adam", lr: float = 0.01, epochs: int = 50, batch: str | None = None, row_mean: bool = False, span: int = 16_000_000) -> tuple[Layers, list[float]]:
    """Synchronous training; returns the layers and the loss of each epoch (of each step before its update).

    A step by rows of many tasks (full batches, the default, or batches of more than
    ``span`` numbers) is one job: each task sums the gradient of its rows, and the
    tasks' arrays are summed in Spark by chunks. Smaller batches (``batch`` is a
    column of whole numbers) leave nothing to share out, as each step needs the
    weights of the one before: the batches are cut into ranges of about ``span``
    numbers, and a task walks through the batches of a range. The weights go from
    range to range, so an epoch takes as many jobs as there are ranges however many
    batches there are, a task holds one range, and a lost executor costs one.

    An epoch's loss is the mean over the batches of their mean losses, so a short
    last batch weighs as much as the others; ``row_mean`` gives the mean over rows.
    Rows without features, target or batch take no part.
    """
    spark = df.sparkSession
    data = df.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), (F.col(batch).cast("long") if batch else F.lit(0).cast("long")).alias("b")).dropna().persist()
    rows, spans, walks = max(1, span // layers[0][0].shape[1]), [None], False
    if batch:
        sizes = data.groupBy("b").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("top")).first()
        walks = (sizes["top"] or 0) <= rows
        if walks and sizes["n"]:
            k = -(-sizes["n"] // rows)
            ends = sorted(set(data.agg(F.percentile_approx("b", [i / k for i in range(1, k)] + [1.0], 100 * k).alias("e")).first()["e"]))  # one per range
            spans = list(zip([None, *ends], [*ends[:-1], None]))
        else:
            spans = [(r["b"], r["b"]) for r in data.select("b").distinct().orderBy("b").collect()]  # batches that fill a range each, for the most part
    flat, shapes, losses = np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers]), [w.shape for w, _ in layers], []
    state = _State(flat, np.zeros_like(flat), np.zeros_like(flat))
    for _ in range(epochs):
        done = np.zeros(4)
        for at in spans:
            shared = spark.sparkContext.broadcast(state)
            if walks:
                part = data.where((F.lit(True) if at[0] is None else F.col("b") > at[0]) & (F.lit(True) if at[1] is None else F.col("b") <= at[1]))
                got = part.groupBy(F.lit(0).alias("one")).applyInArrow(_walk(shared, shapes, loss, optimizer, lr), SCHEMA).collect()
                if got:
                    got = np.concatenate([np.array(v) for _, v in sorted((r["chunk"], r["v"]) for r in got)])
                    done += got[:4]
                    state = _State(*np.split(got[5:], 3), int(got[4]))
            else:
                part = data if at is None else data.where(F.col("b").between(*at))

                def add(own: np.ndarray, b: pa.RecordBatch, shared=shared) -> None:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    lost, g = _gradient(x, b.column(1).to_numpy(zero_copy_only=False), _unflat(shared.value.flat, shapes), loss)
                    own[0] += b.num_rows
                    own[1] += lost
                    own[2:] += g

                got = task_sums(part, lambda: np.zeros(2 + len(flat)), add)
                if len(got):
                    state = copy.deepcopy(state)
                    state.step(got[2:] / got[0], optimizer, lr)
                    done += (1, got[1] / got[0], got[1], got[0])
            shared.destroy()
        steps, mean, each, n = done
        losses.append(float(each / max(1.0, n) if row_mean else mean / max(1.0, steps)))
    data.unpersist()
    return _unflat(state.flat, shapes), losses


def save_model(spark: SparkSession, layers: Layers, path: str) -> None:
    """The model table: one row per chunk of a layer's weights or biases (layer, kind, chunk, shape, v)."""
    rows = []
    for k, (w, b) in enumerate(layers):
        for kind, a in (("weight", w), ("bias", b)):
            flat = a.ravel()
            rows += [(k, kind, i, list(a.shape), [float(v) for v in flat[at : at + CHUNK]]) for i, at in enumerate(range(0, flat.size, CHUNK))]
    spark.createDataFrame(rows, "layer int, kind string, chunk int, shape array<int>, v array<double>").write.parquet(path)


def load_model(spark: SparkSession, path: str) -> Layers:
    at: dict[tuple[int, str], list] = {}
    for r in spark.read.parquet(path).orderBy("layer", "kind", "chunk").collect():
        at.setdefault((r["layer"], r["kind"]), [r["shape"], []])[1].extend(r["v"])
    return [tuple(np.array(at[k, kind][1]).reshape(at[k, kind][0]) for kind in ("weight", "bias")) for k in range(1 + max(k for k, _ in at))]


def model_sizes(model: DataFrame) -> DataFrame:
    """(layer, kind, n_params) of a stored model table."""
    return model.groupBy("layer", "kind").agg(F.sum(F.size("v")).cast("long").alias("n_params"))


def parameter_count(model: DataFrame) -> DataFrame:
    """Parameters per layer, and in all (layer null)."""
    return model.groupBy("layer").agg(F.sum("n_params").alias("n_params")).union(model.agg(F.lit(None).cast("int"), F.sum("n_params")))

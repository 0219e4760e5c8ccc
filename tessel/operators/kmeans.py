"""K-means by Lloyd's steps over a column of vectors: k * d numbers a task, whatever the rows.

A step doesn't look at every row. A reference table keeps, for each row, its nearest
centroid of that time with the distance u to it and the distance l to the second
nearest. When centroids have moved by at most m since, a row with u + m < l - m can't
have changed, so the filter u + 2 m >= l leaves only rows near a border (vectors of
the others aren't read), and sums are corrected by the rows that did change. Once the
border rows are many, the table is made anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .arrays import task_sums

BLOCK = 4_096  # rows whose distances are held at once


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids: differences first, so equal points are equally far."""
    return np.stack([((x - v) ** 2).sum(1) for v in c], axis=1)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, the lowest index on ties; distance; distance of the second nearest) of each row."""
    a, u, l = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    for z in range(0, len(x), BLOCK):
        d = distances(x[z : z + BLOCK], c)
        at = np.arange(len(d))
        a[z : z + BLOCK] = best = d.argmin(1)
        u[z : z + BLOCK] = np.sqrt(d[at, best])
        if len(c) > 1:
            d[at, best] = np.inf
            l[z : z + BLOCK] = np.sqrt(d.min(1))
    return a, u, l


def _rows(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that hold ``dim`` numbers, their matrix)."""
    keep = np.array([v is not None and len(v) == dim and None not in v for v in col.to_pylist()], bool) if col.null_count or col.flatten().null_count or len(col.flatten()) != len(col) * dim else np.ones(len(col), bool)
    part = col.filter(pa.array(keep))
    return np.flatnonzero(keep), part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def assign_vectors(df: DataFrame, vector: str, centroids: np.ndarray, out: str = "cluster") -> DataFrame:
    """Add ``out``: the nearest centroid, the lowest index on ties; null where the vector is null, holds nulls or has another length."""
    c = np.asarray(centroids, np.float64)
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = _rows(b.column(at), c.shape[1])
            k, seen = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, bool)
            k[keep], seen[keep] = _nearest(x, c)[0], True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, mask=~seen)], [*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, IntegerType())]))


def assign(df: DataFrame, cols: list[str], centroids: list[list[float]]) -> DataFrame:
    """As :func:`assign_vectors` for numbers in columns; adds ``cluster``."""
    return assign_vectors(df.withColumn("_v", F.array(*[F.col(c).cast("double") for c in cols])), "_v", centroids).drop("_v")


def _add(own: np.ndarray, x: np.ndarray, a: np.ndarray, k: int, sign: int = 1) -> None:
    """Add the rows to the sums (k x d) and counts (k) of their clusters."""
    d = x.shape[1]
    member = (a[:, None] == np.arange(k)).astype(np.float64)
    own[: k * d] += sign * (member.T @ x).ravel()
    own[k * d : k * d + k] += sign * member.sum(0)


def update_vectors(assigned: DataFrame, vector: str, k: int, dim: int, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, centroid): a cluster without members has no row."""

    def add(own: np.ndarray, b: pa.RecordBatch) -> None:
        b = b.filter(pc.is_valid(b.column(1)))
        keep, x = _rows(b.column(0), dim)
        _add(own, x, b.column(1).to_numpy()[keep], k)

    got = task_sums(assigned.select(vector, cluster), lambda: np.zeros(k * (dim + 1)), add)
    got = got if len(got) else np.zeros(k * (dim + 1))
    rows = [(j, int(got[k * dim + j]), (got[j * dim : (j + 1) * dim] / got[k * dim + j]).tolist()) for j in range(k) if got[k * dim + j]]
    return assigned.sparkSession.createDataFrame(rows, "cluster int, n long, centroid array<double>")


def update(assigned: DataFrame, cols: list[str]) -> DataFrame:
    """(cluster, n, means); a cluster without members has no row."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])


@dataclass
class KMeans:
    centroids: list[list[float]]  # those the labels refer to
    labels: DataFrame
    history: list[tuple[int, list[list[float]], list[int]]]  # per kept step: updated centroids, members before the update
    steps: int
    looked_at: list[int]  # rows whose distances each step computed


def _reference(df: DataFrame, vector: str, c: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = _rows(b.column(0), c.shape[1])
            a, u, l = _nearest(x, c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(a.astype(np.int32)), pa.array(u), pa.array(l)], ["x", "a", "u", "l"])

    return df.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, "x array<double>, a int, u double, l double")


def fit_vectors(df: DataFrame, vector: str, init: list[list[float]], max_iters: int = 100, tol: float = 1e-4, renew: float = 0.25) -> KMeans:
    """Lloyd from given centroids until the Frobenius norm of their change is below ``tol``.

    On that stop the centroids before the last update are kept and the labels
    refer to them; the history leaves the stopping step out. An empty cluster keeps
    its centroid. k * (d + 1) numbers reach the driver in a step. The reference table
    is renewed when more than the share ``renew`` of its rows were looked at.
    """
    now, history, looked, steps, kept, base = np.array(init, np.float64), [], [], 0, None, None
    k, dim = now.shape
    for steps in range(1, max_iters + 1):
        if kept is None:
            fresh = _reference(df, vector, now).persist()

            def add_all(own: np.ndarray, b: pa.RecordBatch) -> None:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, dim)
                _add(own, x, b.column(1).to_numpy(), k)

            sums = task_sums(fresh.select("x", "a"), lambda: np.zeros(k * (dim + 1)), add_all)
            sums = base_sums = sums if len(sums) else np.zeros(k * (dim + 1))
            kept, base, seen = fresh, now, int(base_sums[k * dim :].sum())
            every = seen
        else:
            moved = np.sqrt(((now - base) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
            c = now

            def add_changed(own: np.ndarray, b: pa.RecordBatch) -> None:
                a, u, l = (b.column(i).to_numpy() for i in (1, 2, 3))
                near = np.flatnonzero(u + moved[a] >= (l - moved.max()) * (1 - 1e-9))
                x = b.column(0).take(pa.array(near)).flatten().to_numpy().reshape(len(near), dim)
                to = _nearest(x, c)[0]
                own[-1] += len(near)
                go = to != a[near]
                _add(own, x[go], a[near][go], k, -1)
                _add(own, x[go], to[go], k)

            change = task_sums(kept.where(F.col("u") + 2 * float(moved.max()) >= F.col("l") * (1 - 1e-9)), lambda: np.zeros(k * (dim + 1) + 1), add_changed)
            change = change if len(change) else np.zeros(k * (dim + 1) + 1)
            sums, seen = base_sums + change[:-1], int(change[-1])
        looked.append(seen)
        n = np.rint(sums[k * dim :]).astype(int)
        new = np.where(n[:, None] > 0, sums[: k * dim].reshape(k, dim) / np.maximum(n, 1)[:, None], now)
        if float(np.linalg.norm(new - now)) < tol:
            break
        history.append((steps - 1, new.tolist(), n.tolist()))
        if seen > renew * every and steps > 1 and base is not now:
            kept.unpersist()
            kept = None
        now = new
    if kept is not None:
        kept.unpersist()
    return KMeans(now.tolist(), assign_vectors(df, vector, now), history, steps, looked)


def kmeans_fit(df: DataFrame, cols: list[str], init: list[list[float]], max_iters: int = 100, tol: float = 1e-4) -> KMeans:
    """As :func:`fit_vectors` for numbers in columns."""
    fitted = fit_vectors(df.withColumn("_v", F.array(*[F.col(c).cast("double") for c in cols])), "_v", init, max_iters, tol)
    fitted.labels = fitted.labels.drop("_v")
    return fitted


def kmeans_history(df: DataFrame, cols: list[str], fitted: KMeans) -> DataFrame:
    """(iter, cluster, n, centroid columns): updated centroids with the members they were made of."""
    rows = [(i, k, int(n[k]), *c[k]) for i, c, n in fitted.history for k in range(len(c))]
    return df.sparkSession.createDataFrame(rows, "iter int, cluster int, n long, " + ", ".join(f"{c} double" for c in cols))


def history_vectors(df: DataFrame, fitted: KMeans) -> DataFrame:
    """(iter, cluster, n, centroid) of a fit of vectors."""
    rows = [(i, k, int(n[k]), [float(v) for v in c[k]]) for i, c, n in fitted.history for k in range(len(c))]
    return df.sparkSession.createDataFrame(rows, "iter int, cluster int, n long, centroid array<double>")


def cluster_vs_label(labelled: DataFrame, label: str) -> DataFrame:
    return labelled.groupBy("cluster", F.col(label).alias("label")).agg(F.count("*").alias("n"))

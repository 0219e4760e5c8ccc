"""Sums of long arrays over the tasks of a job: each task sums its own, Spark adds them up.

A task hands its array on in chunks, so that no row grows with the array. Chunks
meet by number in two levels, FAN tasks to a group at most on the first: no task
adds up more than the larger of FAN and (tasks / FAN) chunks at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4_096
FAN = 64
SCHEMA = "part int, chunk int, v array<double>"


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow array of lists."""
    x = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers as a matrix of doubles; nulls become NaN."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def task_rows(v: np.ndarray) -> pa.RecordBatch:
    """The chunks of one task's array, as rows of SCHEMA."""
    cut = np.append(np.arange(0, len(v), CHUNK), len(v)).astype(np.int32)
    k = len(cut) - 1
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.float64)))], ["part", "chunk", "v"])


def _added(rows: Column) -> Column:
    """Sum by position of the arrays of (part, v), in the order of ``part``: reruns give the same doubles."""
    ordered = F.sort_array(rows)
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), ordered[0]["v"], lambda s, r: F.zip_with(s, r["v"], lambda a, b: a + b))


def total(parts: DataFrame, length: int) -> np.ndarray:
    """The sum of the tasks' arrays (rows of SCHEMA) of ``length`` numbers; empty without rows.

    Sums of FAN tasks reach the driver if the array is one chunk, else their sums.
    """
    one = parts.groupBy("chunk", F.expr(f"part div {FAN}").cast("int").alias("part")).agg(_added(F.collect_list(F.struct("part", "v"))).alias("v"))
    if length > CHUNK:
        one = one.groupBy("chunk").agg(_added(F.collect_list(F.struct("part", "v"))).alias("v")).select("chunk", F.lit(0).alias("part"), "v")
    sums: dict[int, np.ndarray] = {}
    for r in sorted(one.collect(), key=lambda r: (r["chunk"], r["part"])):
        sums[r["chunk"]] = sums.get(r["chunk"], 0.0) + np.array(r["v"])
    return np.concatenate([sums[c] for c in sorted(sums)]) if sums else np.zeros(0)


def task_sums(df: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """``add`` every batch of a task into its own array, and sum up the tasks' arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_ = start(), False
        for b in batches:
            if b.num_rows:
                add(own, b)
                any_ = True
        if any_:
            yield task_rows(own)

    return total(df.mapInArrow(run, SCHEMA), len(start()))


def moments(df: DataFrame, vector: str, dim: int, block: int = 4_096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, scatter) of the components of a column of arrays of ``dim`` numbers, nulls left out pair by pair.

    ``n[i, j]`` counts the rows in which both are present, ``scatter[i, j]`` sums
    the products of their deviations from the means over these rows, and
    ``mean[i]`` is over the rows that hold i. The first pass takes the means, the
    second multiplies centred values as blocks of rows: a task holds one Gram
    matrix of dim x dim numbers however many rows it reads.
    """
    tri = np.triu_indices(dim)

    def add_first(own: np.ndarray, b: pa.RecordBatch) -> None:
        x = matrix(b.column(0), dim)
        seen = _present(b.column(0), dim)
        own[:dim] += seen.sum(0)
        own[dim:] += np.where(seen, x, 0.0).sum(0)

    only = df.select(F.col(vector).alias("v")).where("v is not null")
    first = task_sums(only, lambda: np.zeros(2 * dim), add_first)
    if not len(first):
        return np.zeros((dim, dim)), np.full(dim, np.nan), np.zeros((dim, dim))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = first[dim:] / first[:dim]
    size = len(tri[0])

    def add_second(own: np.ndarray, b: pa.RecordBatch) -> None:
        col = b.column(0)
        for a in range(0, len(col), block):
            part = col.slice(a, block)
            seen = _present(part, dim)
            x = np.where(seen, matrix(part, dim) - mean, 0.0)
            m = seen.astype(np.float64)
            own[:size] += (x.T @ x)[tri]
            own[size : 2 * size] += (m.T @ m)[tri]
            own[2 * size :] += (x.T @ m).ravel()

    second = task_sums(only, lambda: np.zeros(2 * size + dim * dim), add_second)
    both, n = np.zeros((dim, dim)), np.zeros((dim, dim))
    both[tri], n[tri] = second[:size], second[size : 2 * size]
    both, n = both + np.triu(both, 1).T, n + np.triu(n, 1).T
    left = second[2 * size :].reshape(dim, dim)  # [i, j]: deviations of i over the rows that hold j
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, mean, both - np.where(n > 0, left * left.T / n, 0.0)


def _present(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().is_valid().to_numpy(zero_copy_only=False).reshape(len(col), dim)

"""Embedding whitening: single-precision eigenvectors, refined by Ogita-Aishima iterations.

1. One pass takes the number of vectors and the exact sums of every dimension.
2. A second pass sums one centred Gram matrix a task (``operators.arrays``): the
   covariance, with divisor n. Only d x d numbers reach the driver.
3. The driver takes eigenvectors of the covariance in single precision and refines
   them by products of d x d matrices (Ogita and Aishima, 2018): with
   R = I - X'X and S = X'AX, an entry of the correction is
   (s_ij + l_j r_ij) / (l_j - l_i) where two eigenvalues l are further apart than
   the present error, and r_ij / 2 where they aren't. The error is squared by each
   step. The first step is in doubles, the later ones in extended precision
   (``numpy.longdouble``).
4. Eigenvalues closer than the error form clusters. The steps make the span of a
   cluster right, not the vectors in it; those come from a sub-solve (Ogita and
   Aishima, 2019): the cluster's part of A, shifted by its mean eigenvalue, is
   formed in extended precision and its small eigenproblem solved, which parts the
   eigenvalues that the shift uncovers. Then refinement goes on.
5. A third pass projects the rows.

Defined results: vectors that are null, empty, hold nulls or values that aren't
finite, or have another dimension than the most frequent one (the smaller of equally
frequent ones) take no part; rows with a null id and repeated rows are rows like
others; entries so large that ``floor(scale * c)`` doesn't fit 62 bits take no part
either; a component without variance (beyond rounding) is null in ``whitened``, and
so is ``explained`` if no dimension varies; eigenvalues that agree to the last digit
have some orthonormal vectors of their span; no rows give no rows.
``deviation`` is null where it doesn't fit a long; ``deviation_text`` always holds
it. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrays import lists, matrix, task_sums
from ._shared import materialize, table

SCALE, SHIFT = 1024, 100_000
WIDE = np.longdouble
STEPS = 30


# --- the eigenproblem ----------------------------------------------------------


def step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step in the precision of ``x``: the refined vectors, eigenvalues, the distance below which eigenvalues count as one, and the size of the correction."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a.astype(x.dtype) @ x)
    s = (s + s.T) / 2  # rounding must not tilt a pair of vectors
    value = np.diag(s) / (1 - np.diag(r))
    near = 2 * (np.linalg.norm((s - np.diag(value)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    apart = value[None, :] - value[:, None]
    far = np.abs(apart) > near
    e = np.where(far, (s + value[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, value, near, float(np.abs(e).max())


def clusters(value: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other within ``near``, two or more."""
    order = np.argsort(-value, kind="stable")
    cut = np.flatnonzero(-np.diff(value[order]) > near) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined_eigh(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    top = float(np.abs(a).max(initial=0.0))
    if not top:
        return np.zeros(len(a)), np.eye(len(a))
    top = 2.0 ** np.floor(np.log2(top))  # single precision holds the scaled matrix whatever its size; a power of two rounds nothing
    a = (a + a.T) / 2 / top
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    x, value, near, _ = step(a, x)
    x, rounding, last, moved, solved = x.astype(WIDE), 8 * float(np.finfo(np.float64).eps), np.inf, np.inf, True
    for _ in range(STEPS):
        x, value, near, size = step(a, x)
        close = clusters(value.astype(float), near)
        for c in close:  # sub-solve: a cluster's own, shifted problem
            y = x[:, c]
            mean = value[c].mean()
            t = y.T @ (a.astype(WIDE) @ y - mean * y)
            w = np.linalg.eigh(((t + t.T) / 2 / max(float(np.abs(t).max()), 1e-300)).astype(float))[1]
            x[:, c] = y @ w.astype(WIDE)
        # Done when corrections vanish or have stopped shrinking. A cluster that stays together while the error has stopped shrinking is a multiple eigenvalue.
        if (size < rounding or (size >= moved / 2 and not solved)) and (not close or near >= last / 2):
            break
        last, moved, solved = near, size, bool(close)
    x = x + x @ ((np.eye(len(a), dtype=WIDE) - x.T @ x) / 2)  # what the last corrections leave of orthogonality is their square
    value = ((x * (a.astype(WIDE) @ x)).sum(0) / (x * x).sum(0)).astype(float)
    x = (x / np.sqrt((x * x).sum(0))).astype(float)
    order = np.argsort(-value, kind="stable")
    return value[order] * top, x[:, order]


# --- passes over the vectors -----------------------------------------------------


def usable(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """(id, x as longs) of the rows that take part, and their dimension (0 without any)."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**62 / scale - shift))
    fine = F.forall("v", fits)
    good = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    top = dims.agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d")).first()["d"] or 0
    # Guarded, as Spark may evaluate it before the filter.
    x = F.transform("v", lambda c: F.when(fits(c), F.floor(c * scale) + F.lit(shift).cast("long")))
    return good.where(F.size("v") == top).select("id", x.alias("x")), top


def _integers(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), dim)


def sums(x: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of every dimension."""
    r = x.select(F.posexplode("x").alias("p", "c")).groupBy("p").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()  # dim rows
    at = {y["p"]: y for y in r}
    return int(at[0]["n"]), [int(at[i]["s"]) for i in range(dim)]


def fit(x: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and the covariance (divisor n) of x."""
    n, total = sums(x, dim)
    tri = np.triu_indices(dim)
    whole, rest = np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total])

    def add(own: np.ndarray, b: pa.RecordBatch) -> None:
        d = (_integers(b.column(0), dim) - whole) - rest
        own += (d.T @ d)[tri]

    g = np.zeros((dim, dim))
    g[tri] = task_sums(x.select("x"), lambda: np.zeros(len(tri[0])), add) / n
    return n, total, g + np.triu(g, 1).T


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Exact sums of (n x - S)^2 of each row."""
    at = [s // n for s in total]
    d = x - np.array(at, np.int64)  # n x - S = n d - (S mod n)
    rest = [s % n for s in total]
    top = max(int(np.abs(d).max(initial=0)) + 1, 1) * n
    if top * top * len(total) < 2**63:
        y = n * d - np.array(rest, np.int64)
        return (y * y).sum(1).tolist()
    y = n * d.astype(object) - np.array(rest, object)
    return (y * y).sum(1).tolist()


def _project(n: int, total: list[int], value: np.ndarray, vector: np.ndarray, real: np.ndarray):
    whole, rest = np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total])
    map_ = vector[:, real] / np.sqrt(value[real])
    k = vector.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _integers(b.column("x"), len(total))
            w = np.full((len(x), k), np.nan)
            w[:, real] = ((x - whole) - rest) @ map_
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([str(v) for v in _deviations(x, n, total)]), lists(w)], ["id", "deviation_text", "w"])

    return run


def whiten(vectors: DataFrame, k: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_text) of each row of ``vectors`` (id, v) and each of the first k components."""
    x, dim = usable(vectors, scale, shift)
    if not dim:
        empty = vectors.select("id").where("false")
        return empty.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"), ("deviation_text", "string"))])
    n, total, cov = fit(x, dim)
    value, vector = refined_eigh(cov)
    k = min(k, dim)
    trace, value, vector = float(np.trace(cov)), value[:k], vector[:, :k]
    real = value > 64 * dim * np.finfo(float).eps * trace
    like = vectors.select("id", F.lit("").alias("deviation_text"), F.array(F.lit(0.0)).alias("w")).schema
    rows = materialize(x.mapInArrow(_project(n, total, value, vector, real), like), "whitened")
    m = int(real.sum())
    where = np.flatnonzero(real)

    def add(own: np.ndarray, b: pa.RecordBatch) -> None:
        w = matrix(b.column(0), k)[:, where]
        own[:m] += w.sum(0)
        own[m:] += (w.T @ w).ravel()

    error = None
    if m:
        # The projections are centred already; what rounding leaves of their means is taken off.
        got = task_sums(rows.select("w"), lambda: np.zeros(m + m * m), add) / n
        error = float(np.abs(got[m:].reshape(m, m) - np.outer(got[:m], got[:m]) - np.eye(m)).max())
    share = F.array(*[F.lit(float(v / trace)) if trace > 0 else F.lit(None).cast("double") for v in value])
    flat = rows.select("id", "deviation_text", F.posexplode("w").alias("p", "whitened"))
    return flat.select("id", (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation_text").try_cast("long").alias("deviation"), F.nanvl("whitened", F.lit(None)).alias("whitened"),
                       F.get(share, F.col("p")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_text")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return whiten(v).withColumnRenamed("id", "vec_id").drop("deviation_text")

"""Hard negatives by segment summaries: bounds from means and deviations, refined before exact scores.

A vector is cut into segments, each halved again for the next level. Of each
segment the mean m and the deviation s over its w entries are stored. By
Cauchy-Schwarz the inner product of two vectors lies within
sum w m m' plus or minus sum w s s', so with the summaries scaled by sqrt(w) both
ends are two products of short vectors. A pair goes on to the next, finer level only
while its range can still hold a score that is wanted, and to its exact integer
score if all levels leave it.

1. The table is written once with its summaries.
2. Anchors are taken in waves of at most WAVE, dealt by a hash: a wave is the side
   of bounded size (WAVE vectors with their summaries) that travels to all tasks;
   candidates are never moved. Each task keeps the best rows of each anchor as it
   reads on, so its pairs and its result stay bounded, and the k-th best so far is
   the limit that bounds are held against. A first look at a bounded sample gives
   the limit to start with; it is the k-th best of some rows, so it never leaves out
   one of all rows' best.
3. A wave's positives first, then the negatives of each (anchor, positive): rows of
   another label whose score is at least ``low`` of the positive's and not above it.
   A row whose lower bound is above an anchor's best positive is left out by it.
4. The tasks' best rows are ranked per anchor, or per anchor and positive.

Results are exact: bounds only decide what isn't scored.

Defined results: rows with a null id or label, vectors that are null, empty, hold
nulls or values that aren't finite, or have another dimension than the most frequent
one take no part, nor do vectors whose squared length (as integers) doesn't fit 62
bits, as their scores don't fit a long; zero vectors take part. An anchor's own id is
neither its positive nor its negative; rows that repeat id and score for an anchor
count once; of rows that share an anchor's id the smallest (label, vector) asks. Ties
go to the smaller id. Anchors without rows of their label, and positives without
negatives in range, give no rows; so do empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.arrays import lists
from ._shared import materialize, shared_dir, table

WAVE = 16_384  # anchors that travel to the tasks at once, at most about
SAMPLE = 50_000  # rows of the first look, about
TILE = 512  # anchors that meet a batch of candidates at once
BATCH = 4_096  # candidates held at once
SCALE = 256


LEAST, MOST = -(2**63), 2**62


# --- summaries and bounds --------------------------------------------------------


def cuts(dim: int) -> list[np.ndarray]:
    """Borders of the segments of each level: at most 16, 4 and 2 entries long, each level halving those of the one before."""
    levels, at = [], np.array([0, dim])
    for longest in (16, 4, 2):
        while np.diff(at).max() > longest:
            at = np.unique(np.concatenate([at, (at[:-1] + at[1:]) // 2]))
        if not levels or len(at) > len(levels[-1]):
            levels.append(at)
    return levels


def summary(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means beside deviations of the segments, each times the root of its length."""
    size = np.diff(at)
    mean = np.add.reduceat(x, at[:-1], axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return np.hstack([mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1))]).astype(np.float32)


def _ends(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, product) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the range of the inner products of summarised vectors, with room for rounding."""
    h = a.shape[1] // 2
    mid, width = product(a[:, :h], b[:, :h]).astype(np.float64), product(a[:, h:], b[:, h:]).astype(np.float64)
    width += (h + 8) * 2.0**-22 * sizes
    return mid - width, mid + width


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


# --- the best rows of a task -----------------------------------------------------


class Best:
    """The k best (score, id) of each group; rows are added in bulk and thinned out from time to time."""

    def __init__(self, limit: np.ndarray, k: int):
        self.k, self.limit = k, limit.copy()  # a score below its group's limit isn't among the k best
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, ...]] = []

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        ok = score >= self.limit[group]
        if ok.any():
            self.new.append((group[ok], score[ok], id_[ok]))
        if sum(len(n[0]) for n in self.new) > 200_000:
            self.thin()

    def thin(self) -> None:
        g, s, i = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        g, s, i = g[first], s[first], i[first]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        last = rank == self.k - 1
        self.limit[g[last]] = np.maximum(self.limit[g[last]], s[last])
        self.kept, self.new = (g[rank < self.k], s[rank < self.k], i[rank < self.k]), []


# --- scanning candidates ---------------------------------------------------------


@dataclass
class Wave:
    """Anchors of a wave in order of label, and for the second scan their positives."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    levels: list[np.ndarray]
    limit: np.ndarray | None = None  # per group: anchors, or anchors x positives
    positive_ids: np.ndarray | None = None  # anchors x positives
    positives: np.ndarray | None = None  # their scores, LEAST where there are fewer

    def prepare(self) -> None:
        self.own = [summary(self.x.astype(np.float64), at) for at in self.levels]
        self.size = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))


def _survivors(own: list[np.ndarray], size: np.ndarray, other: list[np.ndarray], other_size: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, candidate) places whose range reaches ``low`` and doesn't lie above ``high``, refined level by level."""
    a, c = None, None
    for mine, theirs in zip(own, other):
        if a is None or 4 * len(a) > allowed.size:  # most pairs are left: products of whole blocks
            least, most = _ends(mine, theirs, np.outer(size, other_size), lambda p, q: p @ q.T)
            allowed = allowed & (most >= low[:, None]) & (least <= high[:, None])
            a, c = np.nonzero(allowed)
            continue
        keep = np.zeros(len(a), bool)
        for z in range(0, len(a), 100_000):
            i, j = a[z : z + 100_000], c[z : z + 100_000]
            least, most = _ends(mine[i], theirs[j], size[i] * other_size[j], _pairs)
            keep[z : z + 100_000] = (most >= low[i]) & (least <= high[i])
        a, c = a[keep], c[keep]
    return a, c


def _scan(shared, k: int):
    """The task's best rows of each anchor (first scan), or of each anchor and positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave: Wave = shared.value
        wave.prepare()
        first = wave.positives is None
        n_pos = 1 if first else wave.positives.shape[1]
        best = Best(wave.limit, k)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                label = b.column("label").to_numpy()
                order = np.argsort(label, kind="stable")
                label, id_ = label[order], b.column("id").to_numpy()[order]
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(id_), -1)[order]
                other = [b.column(f"s{i}").flatten().to_numpy(zero_copy_only=False).reshape(len(id_), -1)[order] for i in range(len(wave.levels))]
                size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                for z in range(0, len(wave.ids), TILE):
                    rows = np.arange(z, min(z + TILE, len(wave.ids)))
                    lo, hi = 0, len(id_)
                    if first:  # both sides are in order of label: only the labels of this tile
                        lo, hi = np.searchsorted(label, wave.labels[rows[0]]), np.searchsorted(label, wave.labels[rows[-1]], "right")
                    if lo == hi:
                        continue
                    allowed = ((wave.labels[rows][:, None] == label[lo:hi]) == first) & (wave.ids[rows][:, None] != id_[lo:hi])
                    low = best.limit.reshape(-1, n_pos)[rows].min(1).astype(np.float64)
                    high = np.full(len(rows), np.inf) if first else wave.positives[rows].max(1).astype(np.float64)
                    a, c = _survivors([s[rows] for s in wave.own], wave.size[rows], [s[lo:hi] for s in other], size[lo:hi], low, high, allowed)
                    for y in range(0, len(a), 100_000):
                        i, j = rows[a[y : y + 100_000]], lo + c[y : y + 100_000]
                        score = _pairs(wave.x[i], x[j])  # integers: exact
                        for p in range(n_pos):
                            ok = slice(None) if first else score <= wave.positives[i, p]
                            best.add(i[ok] * n_pos + p, score[ok], id_[j][ok])
        best.thin()
        g, s, i = best.kept
        row, p = g // n_pos, g % n_pos
        none = pa.nulls(len(g), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(wave.ids[row]), none if first else pa.array(wave.positive_ids[row, p]), none if first else pa.array(wave.positives[row, p]), pa.array(i), pa.array(s)], NAMES)

    return run


NAMES = ["anchor_id", "positive_id", "positive_score", "id", "score"]


def _best(rows: DataFrame, wave: Wave, k: int) -> DataFrame:
    """The k best rows of each group of the wave among ``rows``, with their rank."""
    shared = rows.sparkSession.sparkContext.broadcast(wave)
    found = rows.mapInArrow(_scan(shared, k), ", ".join(f"{n} long" for n in NAMES)).dropDuplicates(NAMES)
    rank = F.row_number().over(W.partitionBy(*NAMES[:3]).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# --- the operator ----------------------------------------------------------------


def integers(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(id, label, x as longs) of the rows that take part, and their dimension (0 without any)."""
    # Beyond 2^31 an entry's square alone doesn't fit.
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**31 / scale))
    fine = F.forall("v", fits)
    good = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    good = good.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    # Guarded, as Spark may evaluate it before the filter.
    good = good.select("id", "label", F.transform("v", lambda c: F.when(fits(c), F.floor(c * scale))).alias("x"))
    good = good.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c) < float(MOST))
    top = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d")).first()["d"] or 0
    return good.where(F.size("x") == top), top


def _summarise(levels: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            more = [lists(summary(x, at)) for at in levels] if b.num_rows else [pa.array([], pa.list_(pa.float32()))] * len(levels)
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *[f"s{i}" for i in range(len(levels))]])

    return run


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``anchors`` (id, label, v) among ``vectors`` (id, label, v).

    A negative's score times ``low[1]`` is at least the positive's times ``low[0]``.
    """
    spark = vectors.sparkSession
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    schema = ", ".join(f"{n} {'int' if n == 'rank' else 'long'}" for n in names)
    x, dim = integers(vectors, scale)
    if not dim:
        return spark.createDataFrame([], schema)
    levels = cuts(dim)
    rows = materialize(x.mapInArrow(_summarise(levels), "id long, label long, x array<long>, " + ", ".join(f"s{i} array<float>" for i in range(len(levels)))), "negatives-rows")
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(n // SAMPLE)) == 0) if n >= 4 * SAMPLE else None
    asks = integers(anchors, scale)[0].where(F.size("x") == dim).groupBy("id").agg(F.min(F.struct("label", "x")).alias("a")).select("id", "a.*")
    asks = materialize(asks, "negatives-anchors")
    waves = -(-asks.count() // WAVE)
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for w in range(waves):
        # The broadcast side of a wave's join: about WAVE rows, whatever the table's size.
        own = asks.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == w).orderBy("label", "id").collect()
        if not own:
            continue
        ids, labels = (np.array([r[c] for r in own], np.int64) for c in ("id", "label"))
        wave = Wave(ids, labels, np.array([r["x"] for r in own], np.int64), levels, np.full(len(own), LEAST, np.int64))
        if some is not None:
            at = {v: i for i, v in enumerate(ids.tolist())}
            for r in _best(some, wave, positives).where(F.col("rank") == positives).collect():
                wave.limit[at[r["anchor_id"]]] = r["score"]
        _positives(wave, _best(rows, wave, positives).collect(), positives, low)
        if some is not None:
            spot = {(int(a), int(p), int(s)): (i, j) for i, a in enumerate(ids) for j, (p, s) in enumerate(zip(wave.positive_ids[i], wave.positives[i])) if s != LEAST}
            for r in _best(some, wave, negatives).where(F.col("rank") == negatives).collect():
                i, j = spot[r["anchor_id"], r["positive_id"], r["positive_score"]]
                wave.limit[i * positives + j] = max(wave.limit[i * positives + j], r["score"])
        found = _best(rows, wave, negatives)
        found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if waves else spark.createDataFrame([], schema)


def _positives(wave: Wave, rows: list, k: int, low: tuple[int, int]) -> None:
    """Enter a wave's positives (k rows an anchor at most) and the least score of a negative of each."""
    at = {v: i for i, v in enumerate(wave.ids.tolist())}
    wave.positive_ids = np.zeros((len(wave.ids), k), np.int64)
    wave.positives = np.full((len(wave.ids), k), LEAST, np.int64)
    limit = np.full((len(wave.ids), k), MOST, np.int64)  # above every score
    for r in rows:
        i, j = at[r["anchor_id"]], r["rank"] - 1
        wave.positive_ids[i, j], wave.positives[i, j] = r["id"], r["score"]
        limit[i, j] = -(-low[0] * r["score"] // low[1])
    wave.limit = limit.ravel()


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"))
    return mine(v, v.where("id % 100 = 0"))

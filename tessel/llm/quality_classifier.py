"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of n-grams (one to three words) of word
shapes: runs of upper-case letters, lower-case letters, digits and the marks
themselves, with a sign for a word that equals the one before it. A word of any
length is read to its end: a shape of more than PIECE signs counts as several
words, cut after its marks and then each PIECE signs. They are hashed into ``2**BITS`` places. Each indicator is scaled by its class log-count
ratio, and a linear hinge-loss model is fitted by dual coordinate descent.
Platt's sigmoid, fitted on training rows that the model hasn't seen, turns the
margin into a score.

The log-count ratios, the model and the sigmoid are fitted on at most
``train_rows`` labelled rows, chosen by hash.

Defined results: null and empty texts have one indicator of their own; without
labels, or with labels of one kind only, every score is the (smoothed) share of
good labels; documents with a null doc_id are scored, not held out; repeated
documents are scored each for themselves; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._words import Words, held_out, labelled_texts, word_slices

TRAIN_ROWS = 16_000  # labelled documents that the model is fitted on, at most
BITS = 18
PIECE = 12  # signs of a shape that make one feature
_SAME = re.compile(r"([0Aa])\1+")
_RUN = re.compile(r"(.)\1{2,}", re.S)
_PARTS = re.compile(r"[0Aa]*[^0Aa]+|[0Aa]+")  # letters and digits with the marks behind them


class _Kinds(dict):
    """For str.translate: 0, A, a or the mark itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        k = self[code] = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        return k


_KINDS = _Kinds()


def shape(word: str) -> str:
    """``THE,!!`` -> ``A,!!``, ``erhei***`` -> ``a***``, ``Then`` -> ``Aa``."""
    return _RUN.sub(r"\1\1\1", _SAME.sub(r"\1", word.translate(_KINDS)))


def pieces(word: str) -> list[str]:
    """The word's shape, in parts of at most PIECE signs; all of it."""
    s = shape(word)
    if len(s) <= PIECE:
        return [s]
    return [p[i : i + PIECE] for p in _PARTS.findall(s) for i in range(0, len(p), PIECE)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shaper:
    """Hashes of each distinct word's pieces, remembered over a task's slices (those of long words aren't: they hardly recur)."""

    def __init__(self):
        self.of_word: dict[str, list[int]] = {}

    def codes(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all distinct words on end, and how many each word has."""
        import zlib

        if len(self.of_word) > 300_000:
            self.of_word.clear()
        got = self.of_word
        out: list[int] = []
        size = np.zeros(len(w.uniq), np.int64)
        for i, x in enumerate(w.uniq.to_pylist()):
            h = got.get(x)
            if h is None:
                h = [zlib.crc32(p.encode()) + 1 for p in pieces(x)]
                if len(x) <= 64:
                    got[x] = h
            out += h
            size[i] = len(h)
        return np.array(out, np.uint64), size


def indicators(w: Words, shaper: Shaper) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place) pairs in order: the text's row and the hashed place of each n-gram."""
    mask = np.uint64((1 << BITS) - 1)
    base = np.arange(w.n, dtype=np.uint64) << np.uint64(BITS)
    empty = np.ones(w.n, bool)
    keys = []
    if len(w.code):
        empty[w.row] = False
        codes, size = shaper.codes(w)
        same = np.zeros(len(w.code), np.uint64)
        same[1:] = (w.code[1:] == w.code[:-1]) & (w.row[1:] == w.row[:-1])
        n = size[w.code]  # pieces of each word
        doc = np.repeat(w.row, n)
        at = np.repeat((np.cumsum(size) - size)[w.code] - (np.cumsum(n) - n), n) + np.arange(len(doc))
        h = codes[at] * np.uint64(2) + np.repeat(same, n)
        row = doc.astype(np.uint64) << np.uint64(BITS)
        gram = np.zeros(len(h), np.uint64)
        for k in range(3):
            gram = _mix(gram[: len(h) - k] + h[k:] + np.uint64(k << 40))
            inside = doc[: len(gram)] == doc[k:] if k else slice(None)
            keys.append((row[: len(gram)] | (gram & mask))[inside])
            if len(gram) < 2:
                break
    keys.append(base[empty])  # place 0: no words
    u = np.unique(np.concatenate(keys))
    return (u >> np.uint64(BITS)).astype(np.int64), (u & mask).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # per place, the ratio already multiplied in
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p = np.full(1 << BITS, alpha)
    q = np.full(1 << BITS, alpha)
    for r, t in zip(rows, y):
        (p if t > 0 else q)[r] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], vals: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Weights (the last one the bias) of the hinge-loss machine: one dual variable at a time, 0 <= a_i <= cost_i."""
    w, a, rng = np.zeros(size + 1), np.zeros(len(y)), np.random.default_rng(seed)
    diag = np.array([v @ v + 1.0 for v in vals])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            r, v, t = rows[i], vals[i], y[i]
            g = t * (w[r] @ v + w[size]) - 1
            new = min(max(a[i] - g / diag[i], 0.0), cost[i])
            d = (new - a[i]) * t
            if d:
                w[r] += d * v
                w[size] += d
                a[i] = new
                worst = max(worst, abs(d))
        if worst < 1e-3:
            break
    return w


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / (1e-9 + np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0) -> Model:
    """Model from lists of places and labels 0/1; every fifth row is kept for the sigmoid."""
    y = np.where(y > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        p = ((y > 0).sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, math.log(p / (1 - p)))
    calib = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~calib)
    ratio = log_count_ratio([rows[i] for i in train], y[train])
    scaled = [ratio[r] / max(1e-9, math.sqrt(float(ratio[r] @ ratio[r]))) for r in rows]
    share = max(1, (y[train] > 0).sum()) / len(train)
    costs = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / max(1e-6, 1 - share))
    w = dual_descent([rows[i] for i in train], [scaled[i] for i in train], y[train], costs[train], 1 << BITS)
    m = np.array([w[r] @ v + w[-1] for r, v in zip(rows, scaled)])
    held = np.flatnonzero(calib) if 0 < (y[calib] > 0).sum() < calib.sum() else np.arange(len(y))
    a, b = _platt(m[held], y[held])
    return Model(w[:-1], ratio, float(w[-1]), a, b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    texts = labelled_texts(docs, labels, label, train_rows).select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shaper = Shaper()
        for b in batches:
            for w in word_slices(b.column("text")):
                row, place = indicators(w, shaper)
                cut = np.searchsorted(row, np.arange(w.n + 1))
                blobs = [place[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in range(w.n)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.first, w.n), b.column("y").slice(w.first, w.n), pa.array(blobs, pa.binary())], ["doc_id", "y", "x"])

    got = texts.mapInArrow(run, "doc_id long, y int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return fit_rows([np.frombuffer(bytes(r["x"]), "<i4").astype(np.int64) for r in got], np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) to ``docs``, by their column text; a column of that name is replaced."""
    docs = docs.drop("score")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    both = docs.sparkSession.sparkContext.broadcast((model.weights * model.ratio, model.ratio**2))  # 2**BITS numbers each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift, square = both.value
        shaper = Shaper()
        for b in batches:
            for w in word_slices(b.column("text")):
                row, place = indicators(w, shaper)
                norm = np.sqrt(np.bincount(row, square[place], w.n))
                m = np.bincount(row, lift[place], w.n) / np.maximum(norm, 1e-9) + model.bias
                s = 1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -30, 30)))
                part = b.slice(w.first, w.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

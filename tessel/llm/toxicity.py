"""Toxicity scores: Levenshtein automata on a lexicon trie, and context windows.

1. A lexicon is learned from at most ``train_rows`` labelled documents: words
   and word beginnings (stems) that stand in toxic documents and hardly in
   others, with their log odds.
2. The lexicon is a trie. A word meets it exactly, by a stem, or within one
   edit (a swap of neighbours is one; terms of four letters by a swap only): the
   word's Levenshtein automaton walks along the trie, dead branches are left at
   once. (With one edit, one half of a term stays as it is, or the two letters
   between the halves are swapped, so only such words need the walk; this loses
   no match.)
3. A window of words around each hit tells abuse from quotation: a hit with an
   opening mark before it and a closing mark behind it, no other marks between,
   is quoted; with a reporting word nearby it counts once more. A mark opens at
   the start of a word and closes at the end of one, so an inch mark or a lone
   quote far away changes nothing.
4. A logistic model over the sums of hits, fitted on the same rows, gives the
   score.

Defined results: null and empty texts have no hits and get the model's base
rate; without labels, or with labels of one kind only, the lexicon is empty and
every score is the (smoothed) share of toxic labels; documents with a null
doc_id are scored, not held out; repeated documents are scored each for
themselves; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, tidy
from ._words import Words, held_out, labelled_texts, word_slices

TRAIN_ROWS = 20_000  # labelled documents that the model is fitted on, at most
MIN_ODDS = 3.0  # log odds that a term must have
MIN_CONTEXTS = 6  # words before it, in toxic documents, that a term must be met behind (at least)
STEMS = (4, 5, 6)  # lengths of stems
WINDOW = 6  # words on each side of a hit
TRIM = ".,;:!?\"'()[]{}<>“”„«»‘’…*#$%&|-_"
#: Fixed word list: words that report what others said (en, de, fr, es).
REPORTING = frozenset("said says wrote quoted called sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
QUOTES = "\"“”„«»"
BEFORE, BEHIND = "([{<*_-–—", ".,;:!?…)]}>*_-–—"  # what may stand outside a mark


class Trie:
    """Lexicon trie; ``near(word)`` gives the closest term within one edit as (term, distance), or None."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.terms = set(terms)
        self.left: dict[str, set[int]] = {}  # half of a term -> lengths of such terms
        self.right: dict[str, set[int]] = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            if len(t) >= 5:
                self.left.setdefault(t[: len(t) // 2], set()).add(len(t))
                self.right.setdefault(t[len(t) // 2 :], set()).add(len(t))
        self.left_sizes, self.right_sizes = sorted({len(x) for x in self.left}), sorted({len(x) for x in self.right})

    def exact(self, word: str) -> bool:
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return False
        return "" in node

    def near(self, word: str) -> tuple[str, int] | None:
        halves = [self.left.get(word[:k]) for k in self.left_sizes] + [self.right.get(word[-k:]) for k in self.right_sizes]
        if not any(abs(n - len(word)) <= 1 for sizes in halves if sizes for n in sizes) and not any(word[:i] + word[i + 1] + word[i] + word[i + 2 :] in self.terms for i in range(len(word) - 1)):
            return None
        best = None
        # State of the automaton: the rows of edit distances between the trie path (and the path before its last letter) and each prefix of the word, cut at 1.
        stack = [(self.root, [*range(len(word) + 1)], None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    d = row[-1]
                    if d <= 1 and (len(child) >= 5 or (len(child) == 4 and sorted(child) == sorted(word))) and (best is None or (d, child) < (best[1], best[0])):
                        best = (child, d)
                    continue
                new = [row[0] + 1]
                for j, w in enumerate(word):
                    new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (w != c)))
                    if before and j and c == word[j - 1] and last == w:
                        new[-1] = min(new[-1], before[j - 1] + 1)
                if min(new) <= 1 or (min(row) <= 1 and c in word):
                    stack.append((child, new, row, c))
        return best


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # whole words with log odds
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    bias: float = 0.0


class Matcher:
    def __init__(self, model: Model):
        self.model, self.trie, self.seen = model, Trie(sorted(model.terms)), {}
        self.stem_sizes = sorted({len(s) for s in model.stems})

    def find(self, word: str) -> tuple[float, int] | None:
        """(log odds, kind) of a bare lower-case word; kind 0 exact, 1 stem, 2 one edit away."""
        if self.trie.exact(word):
            return self.model.terms[word], 0
        for k in reversed(self.stem_sizes):
            if (s := word[:k]) in self.model.stems:
                return self.model.stems[s], 1
        if len(word) >= 4 and (hit := self.trie.near(word)):
            return self.model.terms[hit[0]], 2
        return None

    def codes(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Log odds (0: no hit) and kind for each distinct word of a slice."""
        bare = pc.utf8_trim(pc.utf8_lower(w.uniq), characters=TRIM).to_pylist()
        odds, kind = np.zeros(len(bare)), np.zeros(len(bare), np.int64)
        if len(self.seen) > 500_000:
            self.seen.clear()
        for i, b in enumerate(bare):
            if b in self.seen:
                hit = self.seen[b]
            else:
                hit = self.seen[b] = self.find(b) if b else None
            if hit:
                odds[i], kind[i] = hit
        return odds, kind


N_FEATURES = 7


def _marks(word: str) -> tuple[bool, bool]:
    """Whether a quotation may open with this word, and whether one may close with it."""
    head, tail = word.lstrip(BEFORE)[:1], word.rstrip(BEHIND)[-1:]
    return head in QUOTES and head not in ("»", "") or word[-1:] in "«„", tail in QUOTES and tail not in ("«", "„", "")


def quoted(text: list[str], s: int) -> bool:
    """Whether word s stands between an opening and a closing mark, both at most WINDOW words away, with no other marks between."""
    marks = {i: _marks(text[i]) for i in range(max(0, s - WINDOW), min(len(text), s + WINDOW + 1)) if any(q in text[i] for q in QUOTES)}
    opens = marks.get(s, (False, False))[0] or next((marks[i][0] and not (marks[i][1] and len(text[i]) > 1) for i in range(s - 1, s - WINDOW - 1, -1) if i in marks), False)
    closes = marks.get(s, (False, False))[1] or next((marks[i][1] and not (marks[i][0] and len(text[i]) > 1) for i in range(s + 1, s + WINDOW + 1) if i in marks), False)
    return opens and closes


def features(w: Words, m: Matcher) -> np.ndarray:
    """Per text: exact, stem, near and quoted log odds (log of the sums), the strongest plain hit, hits a word, hits in reported speech."""
    out = np.zeros((w.n, N_FEATURES))
    if not len(w.code):
        return out
    odds, kind = m.codes(w)
    is_hit = odds[w.code] > 0
    for i in np.unique(w.row[is_hit]).tolist():
        a, b = np.searchsorted(w.row, [i, i + 1])
        code = w.code[a:b]
        spots = np.flatnonzero(is_hit[a:b]).tolist()
        text = w.uniq.take(pa.array(code)).to_pylist()
        for s in spots:
            o, k = float(odds[code[s]]), int(kind[code[s]])
            inside = quoted(text, s)
            reported = inside and any(x.lower().strip(TRIM) in REPORTING for x in text[max(0, s - WINDOW) : s + WINDOW + 1])
            out[i, 3 if inside else k] += o
            out[i, 6] += reported
            if not inside:
                out[i, 4] = max(out[i, 4], o if k < 2 else 0.0)
        out[i, 5] = len(spots) / max(1, len(code))
    out[:, [0, 1, 2, 3, 6]] = np.log1p(out[:, [0, 1, 2, 3, 6]])
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per bare word and per stem (marked by a star), summed over each slice."""
    for b in batches:
        label = b.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
        for w in word_slices(b.column("text")):
            bare = pc.utf8_trim(pc.utf8_lower(w.uniq), characters=TRIM).cast(pa.string())
            # One of 64 bits for the word before: copies of one text show the same few bits.
            names = np.array([zlib.crc32(x.encode()) & 63 for x in w.uniq.to_pylist()], np.int64)
            context = np.int64(1) << np.concatenate([[0], names[w.code[:-1]]])[: len(w.code)]
            toxic = label[w.first + w.row] > 0
            forms = [bare] + [pc.if_else(pc.greater(pc.utf8_length(bare), k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, 0, k), "*", ""), "") for k in STEMS]
            for form in forms:
                enc = pc.dictionary_encode(form.cast(pa.large_string()))
                code = np.asarray(enc.indices, dtype=np.int64)[w.code]
                pair = np.unique(code * w.n + w.row)
                y = label[w.first + pair % w.n]
                pos, n = np.bincount(pair // w.n, y, len(enc.dictionary)), np.bincount(pair // w.n, minlength=len(enc.dictionary))
                bits = np.zeros(len(enc.dictionary), np.int64)
                np.bitwise_or.at(bits, code[toxic], context[toxic])
                yield pa.RecordBatch.from_arrays([enc.dictionary.cast(pa.string()), pa.array(pos.astype(np.int64)), pa.array((n - pos).astype(np.int64)), pa.array(bits)], ["t", "pos", "neg", "bits"])


def _lexicon(texts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems of the training rows (text, y).

    A term enters if its share of toxic documents beats the base rate by more
    than chance allows among all terms looked at (Chernoff's bound on the
    binomial tail, divided by the number of terms), its log odds reach
    MIN_ODDS, and it stands behind different words: a chance word of a text
    with many copies always has the same neighbours.
    """
    counts = texts.mapInArrow(tidy(_count_terms), "t string, pos long, neg long, bits long").groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_count(F.bit_or("bits")).alias("contexts"))
    counts = counts.where("length(t) > 2").persist()
    total = texts.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    pos, n = int(total["p"] or 0), int(total["n"])
    if not pos or pos == n:
        counts.unpersist()
        return {}, {}
    base, seen, have = pos / n, F.col("pos") + F.col("neg"), counts.count()
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (n - pos + 1))
    p = F.col("pos") / seen
    gain = seen * (p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0))
    top = counts.where(F.col("pos") > 0).withColumn("odds", odds).where((gain > math.log(max(have, 1) / 0.05)) & (F.col("odds") >= MIN_ODDS) & (F.col("contexts") >= MIN_CONTEXTS))
    top = top.orderBy(F.desc(gain), "t").collect()  # terms of the bounded sample that pass the test
    counts.unpersist()
    terms = {r["t"]: r for r in top if not r["t"].endswith("*")}
    stems: dict[str, float] = {}
    for r in sorted((r for r in top if r["t"].endswith("*")), key=lambda r: (len(r["t"]), r["t"])):
        s = r["t"][:-1]
        below = [terms[t]["pos"] for t in terms if t.startswith(s)]
        # A stem that stands for hardly more than one word says nothing that the word doesn't.
        if not any(s.startswith(x) for x in stems) and r["pos"] > 1.2 * max(below, default=0):
            stems[s] = float(r["odds"])
    whole = [t for t in terms if not any(t.startswith(s) for s in stems)]
    return {t: float(terms[t]["odds"]) for t in whole}, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with a ridge on the weights."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    reg = np.full(len(w), ridge * len(x) / 100 + 1e-3)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(reg), a.T @ (y - p) - reg * w)
        w += step * min(1.0, 10 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Model from at most ``train_rows`` labelled rows; only texts and labels are read."""
    texts = labelled_texts(docs, labels, label, train_rows).select("text", "y").persist()
    terms, stems = _lexicon(texts)
    model = Model(terms, stems)
    matcher = Matcher(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y")
            for w in word_slices(b.column("text")):
                x = features(w, matcher)
                yield pa.RecordBatch.from_arrays([y.slice(w.first, w.n), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = texts.mapInArrow(tidy(run), "y int, x array<double>").collect()
    texts.unpersist()
    y = np.array([r["y"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), N_FEATURES)
    if len(y) and 0 < y.sum() < len(y):
        mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        w, model.bias = fit_logistic((x - mean) / scale, y)
        model.weights, model.mean, model.scale = w.tolist(), mean.tolist(), scale.tolist()
    else:
        p = (y.sum() + 0.5) / (len(y) + 1)
        model.weights, model.mean, model.scale, model.bias = [0.0] * N_FEATURES, [0.0] * N_FEATURES, [1.0] * N_FEATURES, math.log(p / (1 - p))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) to ``docs``, by their column text; a column of that name is replaced."""
    docs = docs.drop("score")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    weights, mean, scale = np.array(model.weights), np.array(model.mean), np.array(model.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in batches:
            for w in word_slices(b.column("text")):
                z = ((features(w, matcher) - mean) / scale) @ weights + model.bias
                part = b.slice(w.first, w.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema=None, names=[*part.schema.names, "score"])

    return docs.mapInArrow(tidy(run), schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

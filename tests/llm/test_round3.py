"""Hard negatives, mixing and whitening: brute force, skew, nulls, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import hard_negatives, mixing, registry, whitening

NAN, INF = float("nan"), float("inf")


# --- whitening ---------------------------------------------------------------


def white(rows):
    out = collections.defaultdict(dict)
    for r in rows:
        out[r["vec_id"] if "vec_id" in r.asDict() else r["id"]][r["component"]] = r
    return out


def test_op13(spark, data):
    rows = registry.QUERIES["op13_whitening"](spark, data).collect()
    e = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(e["embedding"]).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (x - s / n).astype(np.longdouble)
    value, vector = np.linalg.eigh((c.T @ c / n).astype(float))
    out = white(rows)
    assert len(rows) == 8 * n and rows[0]["n"] == n and rows[0]["identity_error"] < 1e-9
    for k in range(8):
        want = (c @ vector[:, -1 - k] / np.sqrt(value[-1 - k])).astype(float)
        got = np.array([out[i][k + 1]["whitened"] for i in e["vec_id"]])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert np.allclose([out[i][k + 1]["explained"] for i in e["vec_id"]], value[-1 - k] / value.sum(), rtol=1e-9)
    assert [out[i][1]["deviation"] for i in e["vec_id"]] == ((n * x - s) ** 2).sum(1).tolist()


@pytest.mark.parametrize("gap", [0.0, 1e-14, 1e-12, 1e-9, 1e-7, 1e-5, 1e-3])
def test_clustered_eigenvalues(gap):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    d = np.repeat([3.0, 2.0, 1.0, 0.5], 10) + np.tile(np.arange(10) * gap, 4)
    a = (q * d) @ q.T
    a = (a + a.T) / 2
    value, x = whitening.refined_eigh(a)
    assert (np.diff(value) <= 1e-15).all() and np.allclose(value, np.sort(d)[::-1], atol=1e-13)
    assert np.abs(a @ x - x * value).max() < 3e-15 and np.abs(x.T @ x - np.eye(40)).max() < 3e-15
    if gap >= 1e-12:
        # Vectors of a cluster are resolved: exact products of the parts of A with them vanish.
        w = x.astype(np.longdouble)
        s = w.T @ (a.astype(np.longdouble) @ w)
        assert np.abs(s - np.diag(np.diag(s))).max() < 1e-15 * max(1, 3e-15 / gap)


def test_refinement_beats_single_precision():
    rng = np.random.default_rng(2)
    a = np.cov(rng.normal(size=(300, 64)).T)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    value = np.diag(x.T @ a @ x)
    assert np.abs(a @ x - x * value).max() > 1e-8
    value, x = whitening.refined_eigh(a)
    assert np.abs(a @ x - x * value).max() < 1e-14
    assert whitening.refined_eigh(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert whitening.refined_eigh(np.diag([1.0, 4.0, 2.0]))[0].tolist() == [4, 2, 1]


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3)], "clash") for i in range(40)]
    bad = [(100, None, "x"), (101, [], "x"), (102, [1.0, None, 2.0], "x"), (103, [NAN, 1.0, 1.0], "x"), (104, [INF, 1.0, 1.0], "x"), (105, [1.0, 2.0], "x"), (106, [1e300, 0.0, 0.0], "x")]
    more = [(7, rows[7][1], "again"), (None, [0.5, 0.5, -0.5], "null id"), (8, [9.0, 9.0, 9.0], "other")]
    schema = "id long, v array<double>, w string"
    d = spark.createDataFrame(rows + bad + more, schema).withColumns({"x": F.lit(1), "component": F.lit("c"), "n": F.lit("n")})
    got = whitening.whiten(d).collect()
    assert len(got) == 43 * 3 and {r["n"] for r in got} == {43} and {r["component"] for r in got} == {1, 2, 3}
    assert not {r["id"] for r in got} & {r[0] for r in bad} and max(r["identity_error"] for r in got) < 1e-10
    assert whitening.whiten(d.where("id > 99")).count() == 2  # the one of dimension 2
    assert whitening.whiten(d.limit(0)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, None, 0)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "id long, v array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    big = whitening.whiten(spark.createDataFrame([(i, [float(i) * 1e13, 2.0]) for i in range(5)], "id long, v array<double>")).where("component = 1").collect()
    x = [int(i * 1e13) * 1024 + 100_000 for i in range(5)]
    assert {r["id"]: int(r["deviation_text"]) for r in big} == {i: (5 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert all((r["deviation"] is None) == (int(r["deviation_text"]) >= 2**63) for r in big)


# --- mixing ------------------------------------------------------------------


def brute_mix(rows, weights=(1, 2, 3), most=3, seed=0):
    """(size, source_size, target, taken) of each row (id, text, source), by the iterative rule."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(z for z, r in zip(size, rows) if r[2] == s) for s in sources}
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    goal, free, left = {}, set(sources), sum(size)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if most * total[s] <= w[s] * level}
        if not over:
            goal |= {s: w[s] * level for s in free}
            break
        goal |= {s: float(most * total[s]) for s in over}
        left -= sum(most * total[s] for s in over)
        free -= over
    out = []
    for s in sources:
        own = sorted((hashlib.md5(f"{seed}|{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], z, r) for z, r in zip(size, rows) if r[2] == s)
        budget, at = int(goal[s] + 0.5), 0
        for _, _, z, r in own:
            part = min(z, max(0, budget % total[s] - at)) if total[s] else 0
            at += z
            out.append((r[0], z, total[s], round(goal[s], 6), (budget // total[s] * z if total[s] else 0) + part))
    return sorted(out, key=str)


def mixed(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=str)


CASES = {
    "skewed": [(i, "w " * (1 + i * 7 % 40), "big" if i % 3 else f"s{i % 8}") for i in range(300)],
    "nulls": [(None, "a b c", None), (None, "a b c", None), (1, None, None), (2, "", "x"), (3, " \t ", "x"), (4, "one two", "y"), (4, "one two", "y"), (5, "a " * 5000, "z"), (6, "q", "Ä"), (7, "q w", "")],
    "capped": [(i, "w " * 3, "tiny" if i < 2 else "small" if i < 9 else "large") for i in range(200)],
    "empty texts": [(1, None, "a"), (2, "", "b")],
}


@pytest.mark.parametrize("name", CASES)
def test_mixing(spark, name, monkeypatch):
    d = spark.createDataFrame(CASES[name], "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "_key": F.lit("clash"), "taken": F.lit(1), "n": F.lit(2)})
    want = brute_mix(CASES[name])
    assert mixed(mixing.mix(d)) == want
    monkeypatch.setattr(mixing, "RANGE", 5)  # many ranges
    m = mixing.mix(d)
    assert mixed(m) == want and mixed(mixing.mix(d.repartition(7))) == want
    for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("o")).collect():
        assert abs(r["t"] - r["g"]) <= 0.5 and r["o"] <= 0
    texts = mixing.emit(m).groupBy("source").agg(F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).alias("w")).collect()
    assert sum(r["w"] for r in texts) == sum(r[4] for r in want)


def test_mixing_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(d).count() == 0 and mixing.emit(mixing.mix(d)).count() == 0


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 997:04d}") for i in range(3000)]
    assert mixed(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))) == brute_mix(rows)


# --- hard negatives ----------------------------------------------------------


def brute_mine(rows, anchors, k=5):
    x = {(i, la, tuple(int(np.floor(256 * c)) for c in v)) for i, la, v in rows}
    out = []
    for a in anchors:
        mine = min((la, v) for i, la, v in x if i == a)
        score = lambda v: sum(p * q for p, q in zip(mine[1], v))
        pos = sorted({(-score(v), i) for i, la, v in x if la == mine[0] and i != a})[:k]
        neg = sorted({(-score(v), i) for i, la, v in x if la != mine[0] and i != a})
        for s, i in pos:
            hit = [(t, j) for t, j in neg if 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(hit)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("dim", [1, 2, 5, 30])
def test_hard_negatives(spark, dim, monkeypatch):
    rng = np.random.default_rng(dim)
    rows = [(i, int(rng.integers(3)), [float(c) for c in np.round(rng.normal(size=dim), 1)]) for i in range(240)]
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(120)]  # a third of all rows hold one vector
    rows += rows[:3] + [(5, 1, [0.0] * dim), (10, 2, rows[20][2])]
    monkeypatch.setattr(hard_negatives, "WAVE", 20)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 40)
    monkeypatch.setattr(hard_negatives, "TILE", 7)
    monkeypatch.setattr(hard_negatives, "BATCH", 50)
    d = spark.createDataFrame(rows, "id long, label long, v array<double>").withColumns({"x": F.lit("clash"), "score": F.lit(1), "s0": F.lit(2), "rank": F.lit(0)})
    got = mined(hard_negatives.mine(d, d.where("id % 5 = 0")))
    assert got == brute_mine(rows, sorted({r[0] for r in rows if r[0] % 5 == 0})) and got


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for dim in (1, 3, 16, 17, 64, 100):
        x, y = np.floor(256 * rng.normal(size=(50, dim))), np.floor(256 * rng.normal(size=(60, dim)))
        exact, spread = x @ y.T, []
        sizes = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        for at in hard_negatives.cuts(dim):
            lo, hi = hard_negatives._ends(hard_negatives.summary(x, at), hard_negatives.summary(y, at), sizes, lambda p, q: p @ q.T)
            assert (lo <= exact).all() and (exact <= hi).all()
            spread.append(float((hi - lo).mean()))
        assert spread == sorted(spread, reverse=True)


def test_hard_negatives_edges(spark):
    good = [(i, i % 2, [float(i % 7), 1.0]) for i in range(20)]
    bad = [(30, None, [1.0, 1.0]), (None, 1, [9.0, 9.0]), (31, 1, None), (32, 1, []), (33, 1, [None, 1.0]), (34, 1, [NAN, 1.0]), (35, 0, [INF, 1.0]), (36, 0, [1.0]), (37, 0, [1e300, 1.0])]
    d = spark.createDataFrame(good + bad, "id long, label int, v array<double>")
    assert mined(hard_negatives.mine(d, d)) == brute_mine(good, range(20))
    none = d.where("id < 0")
    assert mined(hard_negatives.mine(d, none)) == [] and mined(hard_negatives.mine(none, none)) == []
    alone = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], "id long, label int, v array<double>")
    assert mined(hard_negatives.mine(alone, alone)) == []
    big = spark.createDataFrame([(i, i % 2, [float(2**21 + i), float(2**20 - i)]) for i in range(12)], "id long, label int, v array<double>")
    assert mined(hard_negatives.mine(big, big)) == brute_mine([tuple(r) for r in big.collect()], range(12))

"""Operators against small independent numpy versions, invariants and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import encode, kmeans, linear, matrix, metrics, naive_bayes, network, pca, profile, ranking, scale, split, tree
from tessel.operators.images import geometry, hog, hough, pixel, spectral, stencil, tables
from tessel.sources import images


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) + np.repeat([[0, 0, 0], [4, 0, 1], [0, 5, -2]], 100, axis=0)
    return x, spark.createDataFrame([(i, *map(float, r), i // 100) for i, r in enumerate(x)], "id long, a double, b double, c double, y int").persist()


def test_pca_matches_numpy(points):
    x, df = points
    z = scale.standardize(df, ["a", "b", "c"])
    rows = pca.pca_fit(z, ["a", "b", "c"]).collect()
    zx = (x - x.mean(0)) / x.std(0)
    want = np.sort(np.linalg.eigvalsh(np.cov(zx.T)))[::-1]
    assert np.allclose([r["eigenvalue"] for r in rows], want)
    for r in rows:
        v = np.array(r["loading"])
        assert np.allclose(np.cov(zx.T) @ v, r["eigenvalue"] * v) and v[np.argmax(np.round(np.abs(v), 9))] > 0
    share = pca.pca_contribution(pca.pca_fit(z, ["a", "b", "c"])).orderBy("pc").collect()
    assert math.isclose(share[-1]["cum_ratio"], 1.0)


def test_kmeans_keeps_previous_centroids(points):
    x, df = points
    init = x[[0, 150, 250]].tolist()
    fitted = kmeans.kmeans_fit(df, ["a", "b", "c"], init)
    c = np.array(init)
    for _ in range(100):
        k = np.argmin(((x[:, None] - c) ** 2).sum(2), axis=1)
        new = np.array([x[k == j].mean(0) for j in range(3)])
        if np.linalg.norm(new - c) < 1e-4:
            break
        c = new
    assert np.allclose(fitted.centroids, c)
    assert [r["cluster"] for r in fitted.labels.orderBy("id").collect()] == k.tolist()
    spread = [((x[:, None] - np.array(h[1])) ** 2).sum(2).min(1).sum() for h in fitted.history]
    assert all(a >= b - 1e-9 for a, b in zip(spread, spread[1:]))
    far = kmeans.kmeans_fit(df, ["a"], [[0.0], [1e6]], max_iters=2, tol=0.0)
    assert far.centroids[1] == [1e6]


def test_splits(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") < 30, "r").otherwise("s"))
    s = split.train_test_split(df, "id")
    assert s.where("is_test").count() == math.ceil(0.2 * 1003) and s.count() == 1003
    st = split.stratified_split(df, "y", "id")
    assert {r["y"]: r["n"] for r in st.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {"r": 6, "s": 195}
    b = split.assign_batches(df, "id", 64)
    n = {r["batch_id"]: r["n_rows"] for r in split.batch_shapes(b, 99).collect()}
    assert len(n) == 16 and n[15] == 1003 - 15 * 64 and all(n[i] == 64 for i in range(15))
    assert split.sample_with_replacement(df, "id", 50).count() == 50
    assert split.train_test_split(df.limit(0), "id").count() == 0


def test_tree_matches_exhaustive_search(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (120, 2)).astype(float)
    y = ((x[:, 0] > 6).astype(int) + (x[:, 1] > 4)).clip(0, 2)

    def g(v):
        p = np.bincount(v, minlength=3) / max(1, len(v))
        return 1 - (p**2).sum() if len(v) else 0.0

    def grow(rows, depth):
        lab = y[rows]
        best = (0.0, None, None)
        for f in range(2):
            vals = np.unique(x[rows, f])
            for a, b in zip(vals, vals[1:]):
                left = x[rows, f] < (a + b) / 2
                if left.sum() < 5 or (~left).sum() < 5:
                    continue
                gain = round(g(lab) - (left.mean() * g(lab[left]) + (~left).mean() * g(lab[~left])), 12)
                if gain > best[0]:
                    best = (gain, f, (a + b) / 2)
        if depth == 0 or len(set(lab)) == 1 or best[1] is None:
            return int(np.argmax(np.bincount(lab)))
        left = x[rows, best[1]] < best[2]
        return (best[1], best[2], grow(rows[left], depth - 1), grow(rows[~left], depth - 1))

    def walk(t, r):
        while isinstance(t, tuple):
            t = t[2] if r[t[0]] < t[1] else t[3]
        return t

    want = grow(np.arange(120), 3)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, f0 double, f1 double, y int")
    t = tree.tree_fit(df, ["f0", "f1"], "y", 3, 5)
    got = [r["pred"] for r in tree.tree_predict(df, t).orderBy("id").collect()]
    assert got == [walk(want, r) for r in x]
    leaves = [r for r in t.nodes.values() if r["is_leaf"]]
    assert sum(r["n"] for r in leaves) == 120


def test_naive_bayes_modes(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2, (80, 3)), rng.integers(0, 2, 80)
    df = spark.createDataFrame([(i, *map(int, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a int, b int, c int, y int")
    model = naive_bayes.nb_fit(df, ["a", "b", "c"], "y")
    p = np.array([(x[y == k].sum(0) + 1) / ((y == k).sum() + 2) for k in (0, 1)])
    prior = np.array([(y == k).mean() for k in (0, 1)])
    for mode, s in (("present", np.log(prior) + x @ np.log(p).T), ("bernoulli", np.log(prior) + x @ np.log(p).T + (1 - x) @ np.log(1 - p).T)):
        got = [r["pred"] for r in naive_bayes.nb_predict(df, model, ["a", "b", "c"], mode).orderBy("id").collect()]
        assert got == [0 if a >= b - 1e-12 else 1 for a, b in s]


def test_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.5, -2.0, 0.5] + 0.8 + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    f = linear.fit_gd(df, ["a", "b", "c"], "y", 0.01, 200)
    w, b, losses = np.zeros(3), 0.0, []
    for _ in range(200):
        e = x @ w + b - y
        losses.append((e**2).mean())
        w, b = w - 0.01 * 2 * x.T @ e / 200, b - 0.01 * 2 * e.mean()
    assert np.allclose(f.weights, w) and math.isclose(f.bias, b) and np.allclose(f.losses, losses)
    a = linear.fit_adam(df, ["a", "b", "c"], "y", 0.05, 500)
    assert np.allclose(a.weights, [1.5, -2.0, 0.5], atol=0.05)


def test_metrics_with_missing_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert sum(cm.values()) == 4 and cm[(2, 2)] == 0 and len(cm) == 9
    rep = {r["label"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rep["2"]["precision"] == 0 and rep["accuracy"]["f1"] == 0.5 and math.isclose(rep["1"]["precision"], 1 / 3)


def test_encode_and_profile_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (None, "a")], "x int, c string")
    assert {r["column"]: r["missing"] for r in profile.null_counts(df).collect()} == {"x": 1, "c": 1}
    assert profile.drop_missing(df).count() == 1
    assert [tuple(r) for r in encode.dummies(df, ["c"]).orderBy("x").collect()] == [(None, 0), (1, 0), (2, 1)]
    assert profile.profile(df.limit(0)).where("n_rows = 0").count() == 2


def test_matrix_blocks(spark):
    a, b = np.random.default_rng(0).normal(size=(5, 7)), np.random.default_rng(1).normal(size=(7, 4))
    t = lambda m: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")
    for f in (matrix.matmul, lambda x, y: matrix.matmul_blocks(x, y, 3)):
        got = np.zeros((5, 4))
        for r in f(t(a), t(b)).collect():
            got[r["i"], r["j"]] = r["v"]
        assert np.allclose(got, a @ b)


def test_training_lowers_loss(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(list(map(float, r)), float(r[0] - r[1]), int(r[0] > r[1])) for r in x], "x array<double>, y double, k int")
    layers, losses = network.train_mlp(df, "x", "y", network.init_layers([2, 4, 1]), epochs=8, lr=0.05)
    assert losses[-1] < losses[0]
    # one step of plain descent equals the numerical gradient
    net = network.init_layers([2, 3, 2])
    loss = lambda n: float(np.mean([-np.log(np.exp(z[k]) / np.exp(z).sum()) for z, k in zip(network.forward(x, n)[-1], (x[:, 0] > x[:, 1]).astype(int))]))
    after, _ = network.train_mlp(df, "x", "k", net, loss="cross_entropy", optimizer="sgd", lr=0.1, epochs=1)
    eps = 1e-6
    bumped = [(w.copy(), b.copy()) for w, b in net]
    bumped[0][0][1, 0] += eps
    assert math.isclose((net[0][0] - after[0][0])[1, 0] / 0.1, (loss(bumped) - loss(net)) / eps, rel_tol=1e-3, abs_tol=1e-6)


def test_cnn_block():
    x = np.random.default_rng(0).normal(size=(2, 3, 6, 6))
    w, b = np.random.default_rng(1).normal(size=(4, 3, 3, 3)), np.arange(4.0)
    got = network.conv_block(x, w, b)
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    y = np.array([[[[max(0.0, (p[n, :, i : i + 3, j : j + 3] * w[o]).sum() + b[o]) for j in range(6)] for i in range(6)] for o in range(4)] for n in range(2)])
    assert np.allclose(got, y.reshape(2, 4, 3, 2, 3, 2).max(axis=(3, 5)))


def image(spark, a):
    a = np.asarray(a)
    return spark.createDataFrame([(1, *a.shape[:2], a.shape[2] if a.ndim == 3 else 1, [int(v) for v in a.ravel()])], "image_id long, height int, width int, channels int, data array<int>")


def back(df):
    r = df.collect()[0]
    a = np.array(r["data"])
    return a.reshape(r["height"], r["width"]) if r["channels"] == 1 else a.reshape(r["height"], r["width"], r["channels"])


def test_colour_round_trip(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (4, 5, 3))
    p = tables.wide_of_images(image(spark, a))
    assert p.exceptAll(tables.wide_pixels(tables.explode_pixels(image(spark, a)))).count() == 0
    out = pixel.hsv_to_rgb(pixel.bgr_to_hsv(p)).orderBy("y", "x").collect()
    got = np.array([[r["b"], r["g"], r["r"]] for r in out]).reshape(4, 5, 3)
    assert np.abs(got - a).max() <= 1  # truncation
    black = pixel.hsv_to_rgb(pixel.bgr_to_hsv(tables.wide_of_images(image(spark, np.full((2, 2, 3), 90)))), gray_to_black=True).collect()
    assert all(r["r"] == 0 for r in black)


def test_hysteresis_is_one_raster_pass():
    e = np.array([[50.0, 50, 120], [0, 0, 0], [50, 0, 0]])
    # the middle pixel sees 120; the first one is visited before it is raised
    assert stencil.hysteresis_array(e).tolist() == [[0, 255, 255], [0, 0, 0], [0, 0, 0]]
    assert stencil.hysteresis_array(e[:, ::-1]).tolist()[0] == [255, 255, 255]


def test_hysteresis_of_stacks_matches_a_walk():
    rng = np.random.default_rng(11)
    stack = rng.choice([0, 10, 40, 60, 90, 130], (40, 9, 13), p=[0.2, 0.1, 0.3, 0.2, 0.12, 0.08]).astype(float)
    for a, got in zip(stack, stencil.hysteresis_array(stack)):
        e = np.pad(np.where(a >= 100, 255, np.where(a <= 30, 0, a)), 1)
        for y in range(1, 10):
            for x in range(1, 14):
                if 0 < e[y, x] < 100:
                    near = [e[j, i] for j in (y - 1, y, y + 1) for i in (x - 1, x, x + 1) if (j, i) != (y, x)]
                    e[y, x] = 255 if max(near) >= 100 else 0
        assert np.array_equal(got, e[1:-1, 1:-1])


@pytest.mark.parametrize("inclusive", [False, True])
def test_template_search_matches_every_offset(inclusive):
    rng = np.random.default_rng(12)
    for shape, size, values in [((5, 20, 17), (9, 6), 256), ((5, 12, 12, 3), (4, 5), 256), ((4, 10, 10), (3, 3), 2), ((3, 8, 8), (2, 2), 1), ((2, 6, 6), (6, 6), 256), ((2, 4, 4), (5, 2), 9)]:
        stack, t = rng.integers(0, values, shape).astype(float), rng.integers(0, values, size + shape[3:]).astype(float)
        owner, y, x, ssd = geometry.template_stack(stack, t, inclusive)
        want = []
        for i, a in enumerate(stack):
            at = [(float(((a[j : j + size[0], k : k + size[1]] - t) ** 2).sum()), j, k) for j in range(shape[1] - size[0] + inclusive) for k in range(shape[2] - size[1] + inclusive)]
            want += [(i, *min(at))] if at else []
        assert list(zip(owner.tolist(), ssd.tolist(), y.tolist(), x.tolist())) == want


def test_images_of_several_sizes(spark):
    rows = [(i, h, w, 1, [(i * 7 + p) % 256 for p in range(h * w)]) for i, (h, w) in enumerate([(4, 6), (6, 4), (4, 6), (3, 3)])]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data array<int>").coalesce(1)
    got = {r["image_id"]: r for r in stencil.laplacian(df).collect()}
    for i, h, w, _, d in rows:
        assert (got[i]["height"], got[i]["width"]) == (h, w)
        assert got[i]["data"] == stencil.laplacian_array(np.array(d, float).reshape(h, w)).ravel().astype(int).tolist()
    assert stencil.laplacian(df.limit(0)).count() == 0


def test_bilinear_weights(spark):
    a = np.array([[0, 100], [200, 40]])
    got, std = back(geometry.resize_bilinear(image(spark, a), 2.0)), back(geometry.resize_bilinear(image(spark, a), 2.0, standard=True))
    # halfway to the right: the textbook takes the right neighbour, the default the lower one
    assert std[0, 1] == 50 and got[0, 1] == 100 and std[1, 0] == 100 and got[1, 0] == 50


def test_spectral(spark):
    a = np.random.default_rng(0).integers(0, 256, (8, 8))
    rows = spectral.dft2d(image(spark, a)).orderBy("u", "v").collect()
    f = np.array([complex(r["re"], r["im"]) for r in rows]).reshape(8, 8)
    assert np.allclose(f, np.fft.fft2(a))
    whole = spectral.low_pass_array(a.astype(float), by_ratio=10)
    assert np.abs(whole - a).max() <= 1
    with pytest.raises(ValueError):
        spectral.quadrant_shift(spectral.dft2d(image(spark, a)), 7, 8)


def test_hog_b_divides_in_place():
    """A flat ramp: all cells alike at first, so the later of two cells is divided by a sum with the earlier one already small."""
    g = np.tile(np.arange(0, 160, 10.0), (8, 1))
    h = hog.normalize_stack(hog.histogram_stack(g[None], 8, "B"), "B")[0]
    m = np.full((8, 16), 20.0)
    m[:, [0, -1]] = 10.0
    left, right = m[:, :8].sum(), m[:, 8:].sum()
    first = left / math.sqrt(left**2 + right**2 + 1)
    assert math.isclose(h[0, 0].sum(), first) and math.isclose(h[0, 1].sum(), right / math.sqrt(first**2 + right**2 + 1))


def test_hough_line(spark):
    a = np.zeros((16, 16), int)
    a[5] = 255
    img, shift = image(spark, a), int(math.hypot(16, 16))
    v = hough.hough_votes(img)
    assert v.where(f"theta = 90 and rho = {5 + shift}").collect()[0]["votes"] == 16
    assert v.agg(F.sum("votes")).first()[0] == 16 * 180
    y = np.nonzero(hough.drawn(np.array([0]), np.array([5 + shift]), np.array([90]), 1, 16, 16, shift)[0])[0]
    assert set(y.tolist()) == {5} and len(y) == 16
    on = hough.draw_lines(img, 1)  # among equal peaks the first in raster order: rho 4 at a steeper angle
    assert {r["y"] for r in on.collect()} == {4}
    assert hough.hough_votes(img.limit(0)).count() == 0
    assert hough.paint(tables.explode_pixels(img).drop("c"), on, 7).where("v = 7").count() == 16


def brute_votes(a, round_up=False):
    d = math.hypot(*a.shape)
    shift, out = math.ceil(d) if round_up else int(d), {}
    for y, x in zip(*np.nonzero(a == 255)):
        for t in range(180):
            r = math.trunc(round(x * round(math.cos(math.radians(t)), 12) + y * round(math.sin(math.radians(t)), 12), 9))
            out[r + shift, t] = out.get((r + shift, t), 0) + 1
    return out


def test_hough_steps_match_loops(spark):
    """Images of two sizes in one table, and the same edges as scattered pixels."""
    rng = np.random.default_rng(2)
    imgs = {1: rng.integers(0, 2, (9, 12)) * 255, 2: rng.integers(0, 2, (9, 12)) * 255, 3: np.full((6, 5), 255), 4: np.zeros((9, 12), int)}
    df = spark.createDataFrame([(k, *a.shape, 1, [int(v) for v in a.ravel()]) for k, a in imgs.items()], "image_id long, height int, width int, channels int, data array<int>")
    found = lambda d: {(r["image_id"], r["rho"], r["theta"]): r["votes"] for r in d.collect()}
    for up in (False, True):
        assert found(hough.hough_votes(df, up)) == {(k, *c): n for k, a in imgs.items() for c, n in brute_votes(a, up).items()}
    full = brute_votes(np.full((20, 20), 255))
    assert found(hough.hough_votes(image(spark, np.full((20, 20), 255)), wrap=True)) == {(1, *c): n % 256 for c, n in full.items()}
    peak = {(k, *c): n for k, a in imgs.items() for v in [brute_votes(a)] for c, n in v.items() if min(c) >= 1 and n >= max(v.get((c[0] - 1, c[1]), 0), v.get((c[0], c[1] - 1), 0), v.get((c[0] - 1, c[1] - 1), 0))}
    assert found(hough.hough_peaks(df)) == peak
    best = {k: sorted((-n, r, t) for (i, r, t), n in peak.items() if i == k)[:3] for k in imgs}
    lines = sorted((r["image_id"], r["line"], -r["votes"], r["rho"], r["theta"]) for r in hough.top_lines(df, 3).collect())
    assert lines == [(k, i + 1, *v) for k in imgs for i, v in enumerate(best[k])]
    px = tables.explode_pixels(df.where("height = 9")).drop("c").repartition(5)
    assert found(hough.pixel_votes(px, 9, 12)) == {(k, *c): n for k in (1, 2) for c, n in brute_votes(imgs[k]).items()}
    assert hough.pixel_votes(px.limit(0), 9, 12).count() == 0


def test_image_rows_are_not_shuffled(spark):
    df = image(spark, np.arange(256).reshape(16, 16) % 251)
    for d in (hog.hog(df), hog.hog(df, "B"), hog.gradients(df), hog.orientations(df), hough.draw_lines(df), hough.top_lines(df)):
        assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_all_values(spark):
    """Ranges are about even in rows, also of skewed values."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(x),) for x in np.exp(rng.normal(size=4000) * 6)], "x double")
    sizes = [r["count"] for r in ranking.quantile_ranges(df, "x").groupBy("_r").count().collect()]
    assert len(sizes) > 150 and max(sizes) < 80


def test_buckets_of_ranks_follow_the_table(spark):
    """The largest bucket stays as it is when rows grow; ranks are those of a sort, groups without a value included."""
    df = spark.range(30_000).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    h = ranking.draw(7, "id")
    most = [ranking._dealt(df.where(f"id < {n}"), h, 1).groupBy("_b").count().agg(F.max("count")).first()[0] for n in (4_000, 30_000)]
    assert max(most) <= 10
    rows = sorted((r["h"], r["id"], r["g"]) for r in df.withColumn("h", h).collect())
    assert [r["id"] for r in ranking.global_rank(df, h, rows=1).orderBy("rank").collect()] == [i for _, i, _ in rows]
    got = ranking.global_rank(df, h, within=["g"], rows=1).orderBy("rank").collect()
    for g in (None, 1, 2):
        assert [(r["rank"], r["id"]) for r in got if r["g"] == g] == list(enumerate([i for _, i, k in rows if k == g], 1))


def brute_canny(a):
    h, w = a.shape
    k = np.array([[math.exp(-(y * y + x * x) / (2 * 1.4**2)) for x in range(-2, 3)] for y in range(-2, 3)])
    k /= k.sum()

    def around(m, kernel):
        r = len(kernel) // 2
        at = lambda y, x: m[y][x] if 0 <= y < h and 0 <= x < w else 0
        return [[sum(kernel[j][i] * at(y + j - r, x + i - r) for j in range(2 * r + 1) for i in range(2 * r + 1)) for x in range(w)] for y in range(h)]

    cut = lambda m: [[min(255.0, max(0.0, v)) for v in r] for r in m]
    g = [[math.floor(round(v, 9)) for v in r] for r in cut(around(a.tolist(), k))]
    fy, fx = cut(around(g, [[1, 2, 1], [0, 0, 0], [-1, -2, -1]])), cut(around(g, [[1, 0, -1], [2, 0, -2], [1, 0, -1]]))
    e = [[min(255.0, math.hypot(fx[y][x], fy[y][x])) for x in range(w)] for y in range(h)]
    out = [r[:] for r in e]
    for y in range(h):
        for x in range(w):
            d = math.degrees(math.atan(fy[y][x] / max(fx[y][x], 1e-10)))
            d = round(d + 180 if d < -22.5 else d, 9)
            dy, dx = (0, 1) if d <= 22.5 or d > 157.5 else (-1, 1) if d <= 67.5 else (1, 0) if d <= 112.5 else (1, 1)
            inside = lambda v, n: min(n - 1, max(0, v))
            if max(e[inside(y + s * dy, h)][inside(x + s * dx, w)] for s in (1, -1)) > e[y][x]:
                out[y][x] = 0.0
    out = [[255 if v >= 100 else 0 if v <= 30 else v for v in r] for r in out]
    for y in range(h):
        for x in range(w):
            if 30 < out[y][x] < 100:
                near = [out[j][i] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if (j, i) != (y, x)]
                out[y][x] = 255 if max(near) >= 100 else 0
    return np.array(out)


def test_canny_matches_plain_loops(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 90, (12, 14))
    a[3:9, 4:11] += 150
    got = back(stencil.canny(image(spark, a)))
    assert got.any() and np.array_equal(got, brute_canny(a))


def test_wheel_matches_colorsys(spark):
    import colorsys

    for r in pixel.hsv_wheel(spark, 12).collect():
        dx, dy = r["x"] - 6, r["y"] - 6
        want = colorsys.hsv_to_rgb((math.atan2(dy, dx) + math.pi) / (2 * math.pi), 1.0, math.hypot(dx, dy) / 6) if math.hypot(dx, dy) <= 6 else (1, 1, 1)
        assert np.allclose((r["r"], r["g"], r["b"]), want, atol=1e-6)


def test_clusters_of_components(points):
    x, df = points
    z = (x - x.mean(0)) / x.std(0)
    vals, vecs = np.linalg.eigh(np.cov(z.T))
    v = vecs[:, np.argsort(vals)[::-1][:2]]
    v = v * np.sign(v[np.argmax(np.round(np.abs(v), 9), axis=0), [0, 1]])
    s = z @ v
    c = np.array([[p, s[:, 1].mean()] for p in np.quantile(s[:, 0], [1 / 6, 3 / 6, 5 / 6])])
    for _ in range(100):
        k = np.argmin(((s[:, None] - c) ** 2).sum(2), axis=1)
        new = np.array([s[k == j].mean(0) for j in range(3)])
        if np.linalg.norm(new - c) < 1e-4:
            break
        c = new
    out = pca.cluster_on_components(df, ["a", "b", "c"], "y")
    n = [c for c in out.columns if c not in ("cluster", "y", "label")]
    got = sorted(tuple(r) for r in out.select("cluster", *[c for c in out.columns if c != "cluster"]).collect())
    table = {(j, y): int(((k == j) & (np.arange(300) // 100 == y)).sum()) for j in range(3) for y in range(3)}
    assert len(n) == 1 and {(r[0], r[1]): r[2] for r in got if r[2]} == {at: m for at, m in table.items() if m}


def test_score_cnn(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 1, 8, 8))
    convs = [(rng.normal(size=(2, 1, 3, 3)), rng.normal(size=2))]
    dense = [(rng.normal(size=(6, 32)), rng.normal(size=6)), (rng.normal(size=(3, 6)), rng.normal(size=3))]
    df = spark.createDataFrame([(i, [float(v) for v in a.ravel()]) for i, a in enumerate(x)], "id int, x array<double>")
    got = np.array([r["logits"] for r in network.score_cnn(df, "x", (1, 8, 8), convs, dense, rows=2).orderBy("id").collect()])
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    (w, b), want = convs[0], []
    for n in range(5):
        y = np.array([[[max(0.0, (p[n, :, i : i + 3, j : j + 3] * w[o]).sum() + b[o]) for j in range(8)] for i in range(8)] for o in range(2)])
        f = y.reshape(2, 4, 2, 4, 2).max(axis=(2, 4)).ravel()
        want.append(dense[1][0] @ np.maximum(dense[0][0] @ f + dense[0][1], 0) + dense[1][1])
    assert np.allclose(got, want)


def test_picture_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    gray, colour = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (4, 3, 3))
    images.write_images(image(spark, gray), f"{tmp_path}/a")
    images.write_images(image(spark, colour), f"file:{tmp_path}/b")
    (tmp_path / "a" / "broken.png").write_bytes(b"no picture")
    assert np.array_equal(back(images.read_images(spark, f"{tmp_path}/a")), gray)
    assert np.array_equal(back(images.read_images(spark, f"{tmp_path}/b")), colour)


def test_tiles_of_missing_vectors_are_zero(spark):
    df = spark.createDataFrame([(i, [1.0] * 64) for i in (0, 5, 17)], "vec_id long, embedding array<float>")
    rows = {r["image_id"]: np.array(r["data"]).reshape(32, 32) for r in images.tiled_images(df).collect()}
    assert sorted(rows) == [0, 1]
    assert rows[0][:8, :8].all() and rows[0][8:16, 8:16].all() and (rows[0] > 0).sum() == 128 and rows[1][:8, 8:16].all() and (rows[1] > 0).sum() == 64
    assert len(images.tiled_images(df, 3).collect()[0]["data"]) == 3072


@pytest.mark.parametrize("kind", ["even", "hot", "text", "few"])
def test_ordered_rank(spark, kind):
    df = spark.range(3000).withColumn("v", F.expr({"even": "id * 7 % 3001", "hot": "if(id % 3 = 0, 1000, id)", "text": "concat('https://host/', lpad(cast(id * 31 % 2999 as string), 5, '0'))", "few": "if(id % 50 = 0, null, id % 2)"}[kind]))
    rows = ranking.ordered_rank(df, "v").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(3000)) and len({r["id"] for r in rows}) == 3000
    v = [r["v"] for r in rows]
    assert v == sorted(v, key=lambda x: (x is None, x))
    assert ranking.ordered_rank(df.limit(0), "v").count() == 0
    b = split.assign_batches(df, "v", 64, shuffle=False)
    assert sorted(r["n_rows"] for r in split.batch_shapes(b, 99).collect()) == [3000 % 64] + [64] * (3000 // 64)


def test_batches_of_training(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2))
    y = x[:, 0] - x[:, 1]
    df = spark.createDataFrame([(list(map(float, r)), float(t), i % 4) for i, (r, t) in enumerate(zip(x, y))], "x array<double>, y double, b int")
    net = network.init_layers([2, 1])
    got, losses = network.train_mlp(df, "x", "y", net, optimizer="sgd", lr=0.1, epochs=2, batch="b")
    w, c, want = net[0][0].copy(), net[0][1].copy(), []
    for _ in range(2):
        total = 0.0
        for k in range(4):
            xk, yk = x[k::4], y[k::4]
            d = (xk @ w.T + c)[:, 0] - yk
            total += float((d**2).sum())
            w, c = w - 0.1 * 2 * (d @ xk)[None] / len(d), c - 0.1 * 2 * d.sum() / len(d)
        want.append(total / 40)
    assert np.allclose(got[0][0], w) and np.allclose(got[0][1], c) and np.allclose(losses, want)


def skewed_rows(n):
    rng = np.random.default_rng(9)
    x = np.stack([np.exp(rng.normal(size=n) * 3), rng.integers(0, 4, n) * 1.0, rng.normal(size=n)], axis=1)
    y = np.where(x[:, 0] > 1.7, "b", np.where(x[:, 2] > 0.3, "c", "a"))
    y = np.where(rng.random(n) < 0.1, "a", y)
    return x, y


def test_ranges_of_skewed_values_are_even(spark):
    """No range of log-normal values holds over 5 % of the distinct ones."""
    x, y = skewed_rows(20_000)
    df = spark.createDataFrame([(float(v), str(k)) for v, k in zip(x[:, 0], y)], "a double, y string")
    data = tree.ranged(df, ["a"], "y", ["a", "b", "c"], tree.feature_cuts(df, ["a"], 20_000))
    top = data.select(F.get("b", F.lit(0)).alias("b"), F.get("v", F.lit(0)).alias("v")).groupBy("b").agg(F.countDistinct("v").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert top[0] <= 0.05 * len(set(x[:, 0])) and top[1] >= tree.LEAST_RANGES - 1


@pytest.mark.parametrize("leaf", [1, 5, 60])
def test_split_search_skips_only_ranges_that_cannot_win(spark, leaf):
    x, y = skewed_rows(3_000)
    x[::50, 0] = np.nan
    df = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], str(k), i % 2) for i, (r, k) in enumerate(zip(x, y))], "a double, b double, c double, y string, node int")
    got = {r["node"]: r for r in tree.best_split(df, "node", ["a", "b", "c"], "y", ["a", "b", "c"], leaf).collect()}
    for node in (0, 1):
        best = (0.0, 0, 0.0, 0)
        for f in range(3):
            at = (np.arange(3_000) % 2 == node) & ~np.isnan(x[:, f])
            o = np.argsort(x[at, f], kind="stable")
            v, k = x[at, f][o], np.array([y[at][o] == c for c in "abc"]).T.cumsum(0)
            n, all_ = len(v), k[-1]
            for i in np.flatnonzero(v[1:] != v[:-1]):
                left, nl = k[i], i + 1
                if min(nl, n - nl) < leaf:
                    continue
                g = lambda c: 1 - ((c / c.sum()) ** 2).sum()
                gain = round(g(all_) - nl / n * g(left) - (n - nl) / n * g(all_ - left), 12)
                if gain > best[0] + 1e-12:
                    best = (gain, f, (v[i] + v[i + 1]) / 2, nl)
        r = got[node]
        assert (r["feature"], r["n_left"]) == ("abc"[best[1]], best[3]) and math.isclose(r["thr"], best[2]) and math.isclose(r["gain"], best[0], abs_tol=1e-11)


def test_tree_takes_one_job_a_level(spark):
    x, y = skewed_rows(2_000)
    df = spark.createDataFrame([(*map(float, r), str(k)) for r, k in zip(x, y)], "a double, b double, c double, y string").persist()
    calls = []
    plain = tree.best_splits
    tree.best_splits = lambda *a: calls.append(1) or plain(*a)
    try:
        t = tree.tree_fit(df, ["a", "b", "c"], "y", 5, 5)
    finally:
        tree.best_splits = plain
    assert len(calls) == 5
    at = tree.tree_predict(df, t).groupBy("pred").agg(F.count("*").alias("n")).collect()
    leaves = [r for r in t.nodes.values() if r["is_leaf"]]
    assert {r["pred"]: r["n"] for r in at} == {p: sum(r["n"] for r in leaves if r["pred"] == p) for p in {r["pred"] for r in leaves}}


@pytest.mark.parametrize("way", ["walk", "ranges", "jobs"])
def test_training_by_batches_matches_numpy(spark, way):
    """A short last batch, all three ways to take a step, and both means of the loss."""
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(100, 3)), rng.normal(size=100)
    ids = np.minimum(np.arange(100) // 16, 6)
    df = spark.createDataFrame([([float(v) for v in a], float(b), int(k), "clash") for a, b, k in zip(x, y, ids)] + [(None, 1.0, 1, ""), ([1.0, 1.0, 1.0], None, 1, ""), ([1.0, 1.0, 1.0], 1.0, None, "")], "x array<double>, y double, b int, n string").repartition(5)
    net = network.init_layers([3, 4, 1], 1)
    more = {"walk": {}, "ranges": {"span": 60}, "jobs": {"span": 9}}[way]
    state = network._State(*[np.concatenate([np.concatenate([w.ravel(), b]) for w, b in net])] * 3)
    state.m, state.s = np.zeros_like(state.flat), np.zeros_like(state.flat)
    shapes, by_batch, by_row = [w.shape for w, _ in net], [], []
    for _ in range(3):
        means, total = [], 0.0
        for k in range(7):
            lost, g = network._gradient(x[ids == k], y[ids == k], network._unflat(state.flat, shapes), "mse")
            n = (ids == k).sum()
            state.step(g / n, "adam", 0.01)
            means.append(lost / n)
            total += lost
        by_batch.append(np.mean(means))
        by_row.append(total / 100)
    got, losses = network.train_mlp(df, "x", "y", net, epochs=3, batch="b", **more)
    assert np.allclose(np.concatenate([np.concatenate([w.ravel(), b]) for w, b in got]), state.flat) and np.allclose(losses, by_batch)
    if way == "walk":
        assert np.allclose(network.train_mlp(df, "x", "y", net, epochs=3, batch="b", row_mean=True)[1], by_row)
        assert network.train_mlp(df.limit(0), "x", "y", net, epochs=2, batch="b")[1] == [0.0, 0.0]


def test_model_table(spark, tmp_path):
    net = network.init_layers([70, 80, 2], 3)
    network.save_model(spark, net, f"{tmp_path}/m")
    back_ = network.load_model(spark, f"{tmp_path}/m")
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(net, back_))
    counts = network.parameter_count(network.model_sizes(spark.read.parquet(f"{tmp_path}/m"))).collect()
    assert {r["layer"]: r["n_params"] for r in counts} == {0: 70 * 80 + 80, 1: 162, None: 70 * 80 + 80 + 162}


def lloyd(x, c, max_iters=100, tol=1e-4):
    c = np.array(c)
    for steps in range(1, max_iters + 1):
        k = np.argmin(((x[:, None] - c) ** 2).sum(2), axis=1)
        new = np.array([x[k == j].mean(0) if (k == j).any() else c[j] for j in range(len(c))])
        if np.linalg.norm(new - c) < tol:
            break
        c = new
    return c, np.argmin(((x[:, None] - c) ** 2).sum(2), axis=1), steps


@pytest.mark.parametrize("renew", [0.0, 0.25, 2.0])
def test_kmeans_bounds_leave_the_steps_as_they_are(spark, renew):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 20)) + np.repeat(rng.normal(size=(6, 20)) * 1.2, 150, axis=0)
    x[:300] = x[0]  # a third of all rows hold one vector
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [None] * 20)], "id long, x array<double>").repartition(5)
    init = x[[0, 320, 480, 610, 760, 890, 5]].tolist()  # the last is the first again: it stays empty
    fitted = kmeans.fit_vectors(df, "x", init, renew=renew)
    c, k, steps = lloyd(x, init)
    assert fitted.steps == steps and np.allclose(fitted.centroids, c)
    got = {r["id"]: r["cluster"] for r in fitted.labels.collect()}
    assert [got[i] for i in range(900)] == k.tolist() and got[1000] is got[1001] is got[1002] is None
    if renew == 0.25:
        assert min(fitted.looked_at[1:]) < 450  # rows far from every border aren't looked at


def test_wide_plans_do_not_grow(spark):
    df = spark.createDataFrame([(i, [float(i % 7 + j) for j in range(50)]) for i in range(20)], "id long, x array<double>")
    size = lambda k: len(kmeans.assign_vectors(df, "x", np.zeros((k, 50)))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(2) - size(40)) < 50


@pytest.mark.parametrize("length", [3, 5_000])
def test_sums_of_task_arrays(spark, length):
    from tessel.operators import arrays

    def add(own, b):
        own += b.num_rows * np.arange(length)

    assert (arrays.task_sums(spark.range(0, 100, 1, 70), lambda: np.zeros(length), add) == 100 * np.arange(length)).all()
    assert len(arrays.task_sums(spark.range(0), lambda: np.zeros(length), add)) == 0


@pytest.mark.parametrize("form", ["cells", "blocks"])
def test_matmul_with_a_heavy_inner_index(spark, form, monkeypatch):
    """One inner index holds half of all cells."""
    rng = np.random.default_rng(4)
    a, b = np.zeros((400, 60)), np.zeros((60, 300))
    a[:, 7], b[7] = rng.integers(1, 9, 400), rng.integers(1, 9, 300)
    for m in (a, b):
        at = rng.integers(0, m.size, 400)
        m.ravel()[at] = rng.integers(1, 9, 400)
    table = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")
    monkeypatch.setattr(matrix, "SIDE", 16)
    got = matrix.matmul(table(a), table(b)) if form == "cells" else matrix.matmul_blocks(table(a), table(b), 16, 2)
    out = np.zeros((400, 300))
    for r in got.collect():
        out[r["i"], r["j"]] = r["v"]
    assert (out == a @ b).all()


def test_heavy_inner_index_is_dealt_evenly(spark):
    rng = np.random.default_rng(5)
    cells = [(i, 0 if i % 2 else int(rng.integers(1, 500))) for i in range(8_000)]
    x = spark.createDataFrame(cells, "i long, k long")
    y = spark.createDataFrame([(k, j) for j, k in cells], "k long, j long")
    left, right = matrix.dealt(x, y, 64)
    for d in (left, right):
        most = d.groupBy("k", "_p", "_q").count().agg(F.max("count")).first()[0]
        assert most <= 2 * 64
        sizes = sorted(r["n"] for r in d.repartition(16, "k", "_p", "_q").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    pairs = left.where("i < 1000").join(right, ["k", "_p", "_q"]).groupBy("i", "j", "k").count()
    n = {k: sum(c[1] == k for c in cells) for k in {c[1] for c in cells if c[1]}}
    assert pairs.where("k > 0").count() == sum(n[k] for i, k in cells[:1000] if k) and pairs.where("count > 1").count() == 0
    assert pairs.where("k = 0 and i < 100").count() == 50 * 4_000


@pytest.mark.parametrize("wave", [1, 10_000])
def test_annotated_picture_files(spark, tmp_path, wave):
    """Files that match, are missing, are no pictures, lie in a folder of their own, or that nobody asked for."""
    images.write_images(image(spark, np.arange(12).reshape(3, 4)), f"{tmp_path}/p")
    images.write_images(image(spark, np.arange(30).reshape(5, 6)), f"{tmp_path}/p/more")
    (tmp_path / "p" / "broken.png").write_bytes(b"no picture")
    (tmp_path / "p" / "empty.png").write_bytes(b"")
    (tmp_path / "p" / "unasked.png").write_bytes(b"never opened")
    rows = [("1.png", 1), ("1.png", 2), ("more/1.png", 3), ("broken.png", 4), ("empty.png", 5), ("gone.png", 6), (None, 7)]
    got = images.load_annotated_images(spark.createDataFrame(rows, "path string, label int"), f"{tmp_path}/p", wave)
    assert sorted((r["path"], r["label"], r["height"], list(r["data"])) for r in got.found.collect()) == [("1.png", 1, 3, list(range(12))), ("1.png", 2, 3, list(range(12))), ("more/1.png", 3, 5, list(range(30)))]
    assert sorted(r["label"] for r in got.missing.collect()) == [5, 6, 7] and sorted(r["label"] for r in got.unreadable.collect()) == [4]
    none = images.load_annotated_images(spark.createDataFrame([("x", 1)], "path string, label int"), f"{tmp_path}/p", wave)
    assert none.found.count() == 0 and none.missing.count() == 1


def test_tasks_follow_the_bytes_of_pictures(spark, tmp_path):
    """300 small pictures are looked up and read in few tasks, not in one or more each."""
    images.write_images(spark.range(300).selectExpr("id AS image_id", "2 AS height", "2 AS width", "1 AS channels", "array(1, 2, 3, cast(id % 256 as int)) AS data"), f"{tmp_path}/p")
    sc = spark.sparkContext
    sc.setJobGroup("pictures", "pictures")
    try:
        got = images.load_annotated_images(spark.range(310).selectExpr("concat(id, '.png') AS path", "cast(id as int) AS label"), f"{tmp_path}/p").all
        assert got.sparkSession._jsparkSession.equals(spark._jsparkSession)
        rows = got.collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["label"], r["status"], r["data"] and r["data"][3]) for r in rows) == [(i, "found", i % 256) if i < 300 else (i, "missing", None) for i in range(310)]
    track = sc.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("pictures") for s in track.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 40

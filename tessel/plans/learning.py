"""Queries of components, clusters, Naive Bayes, trees, regression and networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import encode, kmeans, linear, metrics, naive_bayes, network, pca, scale, split, tree
from .registry import query, scratch, table

# --- principal components ----------------------------------------------------

PAIR = ["l_quantity", "l_extendedprice"]
ZP = "(SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem)"
#: Two standardised columns with covariance matrix [[v, c], [c, v]]: eigenvalues v + |c| and v - |c|.
EIG = f"(SELECT var_samp(a) AS v, abs(covar_samp(a, b)) AS c, CASE WHEN covar_samp(a, b) >= 0 THEN 1 ELSE -1 END AS s FROM {ZP} z)"


def zpair(spark, d):
    return scale.standardize(table(spark, d, "lineitem").select(*PAIR), PAIR)


@query("t5_pca_fit", f"SELECT 1 AS pc, round(v + c, 6) AS eigenvalue, round(sqrt(0.5), 6) AS w1, round(s * sqrt(0.5), 6) AS w2 FROM {EIG} e UNION ALL SELECT 2, round(v - c, 6), round(sqrt(0.5), 6), round(-s * sqrt(0.5), 6) FROM {EIG} e")
def t5(spark, d):
    m = pca.pca_fit(zpair(spark, d), PAIR)
    return m.select("pc", F.round("eigenvalue", 6).alias("eigenvalue"), *[F.round(F.get("loading", F.lit(i)), 6).alias(f"w{i + 1}") for i in (0, 1)])


@query("t5_pca_wide", """SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_samp(CAST(embedding[i] AS DOUBLE), CAST(embedding[j] AS DOUBLE)), 9) AS cov, CAST(i = j AS INTEGER) AS one FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j""")
def t5_wide(spark, d):
    """All 64 components: eigenvalues and loadings are right if loadings are orthonormal and sum_k l_k v_k v_k' is the covariance."""
    m = pca.pca_fit_vector(table(spark, d, "embeddings"), "embedding", 64).select("pc", "eigenvalue", F.posexplode("loading").alias("p", "w"))
    a, b = (m.select("pc", "eigenvalue", (F.col("p") + 1).alias(i), F.col("w").alias(f"w{i}")) for i in "ij")
    back = a.join(b.drop("eigenvalue"), "pc").groupBy("i", "j").agg(F.sum(F.col("eigenvalue") * F.col("wi") * F.col("wj")).alias("cov"), F.sum(F.col("wi") * F.col("wj")).alias("one"))
    return back.select("i", "j", F.round("cov", 9).alias("cov"), F.round("one", 9).cast("int").alias("one"))


@query("t6_pca_project", f"SELECT round(avg(abs(a + s * b) * sqrt(0.5)), 6) AS m1, round(avg(abs(a - s * b) * sqrt(0.5)), 6) AS m2, round(sum((a + s * b) * (a + s * b) * 0.5) / count(*), 6) AS v1, count(*) AS n FROM {ZP} z, {EIG} e")
def t6(spark, d):
    z = zpair(spark, d)
    p = pca.pca_project(z, pca.pca_fit(z, PAIR), PAIR, 2)
    return p.agg(F.round(F.avg(F.abs("pc1")), 6).alias("m1"), F.round(F.avg(F.abs("pc2")), 6).alias("m2"), F.round(F.avg(F.col("pc1") * F.col("pc1")), 6).alias("v1"), F.count("*").alias("n"))


@query("t7_pca_contribution", f"SELECT 1 AS pc, round((v + c) / (2 * v), 6) AS ratio, round((v + c) / (2 * v), 6) AS cum_ratio FROM {EIG} e UNION ALL SELECT 2, round((v - c) / (2 * v), 6), CAST(1 AS DOUBLE) FROM {EIG} e")
def t7(spark, d):
    c = pca.pca_contribution(pca.pca_fit(zpair(spark, d), PAIR))
    return c.select("pc", F.round("ratio", 6).alias("ratio"), F.round("cum_ratio", 6).alias("cum_ratio"))


@query("t8_pca_library", f"SELECT 1 AS pc, round((v + c) / (2 * v), 6) AS ratio, round(sqrt(0.5), 6) AS size1, round(sqrt(0.5), 6) AS size2 FROM {EIG} e UNION ALL SELECT 2, round((v - c) / (2 * v), 6), round(sqrt(0.5), 6), round(sqrt(0.5), 6) FROM {EIG} e")
def t8(spark, d):
    c = pca.pca_library(zpair(spark, d), PAIR, 2)
    return c.select("pc", F.round("ratio", 6).alias("ratio"), *[F.round(F.get("size", F.lit(i)), 6).alias(f"size{i + 1}") for i in (0, 1)])


def vectors(spark, d, k: int):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(k)])


@query("t9_cluster_on_components")
def t9(spark, d):
    return pca.cluster_on_components(vectors(spark, d, 8), [f"x{i}" for i in range(8)], "label")


# --- k-means -----------------------------------------------------------------

K = 5
#: Points are the vectors with all their components; the first K are the start.
KP = "p AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"


def _place(c: str) -> str:
    d = f"list_transform(range(1, {K + 1}), lambda q: list_sum(list_transform(range(1, 65), lambda j: power(x[j] - {c}[q][j], 2))))"
    return f"list_position({d}, list_min({d}))"


#: States (i, cs, mv) of Lloyd: centroids after i updates and how far the last one moved them. A step that moves them by less than 1e-4 is the last, and taken back.
KS = f"""{KP}, s AS (SELECT 0 AS i, (SELECT list(x ORDER BY vec_id) FROM p WHERE vec_id < {K}) AS cs, CAST(1e9 AS DOUBLE) AS mv
 UNION ALL SELECT i + 1, ncs, sqrt(list_sum(list_transform(range(1, {K + 1}), lambda q: list_sum(list_transform(range(1, 65), lambda j: power(ncs[q][j] - cs[q][j], 2)))))) FROM
 (SELECT i, cs, list_transform(range(1, {K + 1}), lambda q: coalesce(list_filter(ms, lambda m: m.k = q)[1].c, cs[q])) AS ncs FROM
 (SELECT i, cs, list({{'k': k, 'c': c}}) AS ms FROM (SELECT i, cs, k, list(m ORDER BY j) AS c FROM (SELECT i, cs, k, j, avg(x[j]) AS m FROM
 (SELECT s.i, s.cs, p.x, {_place("s.cs")} AS k FROM s, p WHERE s.mv >= 1e-4 AND s.i < 100), (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL) GROUP BY i, cs, k) GROUP BY i, cs)))"""
K_END = f"{KS}, e AS (SELECT cs FROM s WHERE mv >= 1e-4 ORDER BY i DESC LIMIT 1), z AS (SELECT vec_id, label, CAST({_place('cs')} - 1 AS INTEGER) AS cluster FROM p, e)"
K_START = f"{KP}, s AS (SELECT (SELECT list(x ORDER BY vec_id) FROM p WHERE vec_id < {K}) AS cs), z AS (SELECT vec_id, x, CAST({_place('cs')} - 1 AS INTEGER) AS cluster FROM p, s)"


def points(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return p, [r["x"] for r in p.where(F.col("vec_id") < K).orderBy("vec_id").collect()]


@query("k1_assign", f"WITH {K_START} SELECT vec_id, cluster FROM z")
def k1(spark, d):
    p, start = points(spark, d)
    return kmeans.assign_vectors(p, "x", start).select("vec_id", "cluster")


@query("k2_update", f"WITH {K_START} SELECT cluster, n, CAST(j AS INTEGER) AS pos, round(m, 9) AS value FROM (SELECT cluster, j, count(*) AS n, avg(x[j]) AS m FROM z, (SELECT unnest(range(1, 65)) AS j) GROUP BY 1, 2)")
def k2(spark, d):
    p, start = points(spark, d)
    u = kmeans.update_vectors(kmeans.assign_vectors(p, "x", start), "x", K, 64)
    return u.select("cluster", "n", F.posexplode("centroid").alias("pos", "value")).select("cluster", "n", (F.col("pos") + 1).alias("pos"), F.round("value", 9).alias("value"))


@query("k3_kmeans_fit", f"WITH RECURSIVE {K_END} SELECT vec_id, cluster FROM z")
def k3(spark, d):
    p, start = points(spark, d)
    return kmeans.fit_vectors(p, "x", start).labels.select("vec_id", "cluster")


@query("k4_kmeans_history", f"""WITH RECURSIVE {KS}, h AS (SELECT i, k, count(*) AS n FROM (SELECT s.i, {_place('s.cs')} AS k FROM s, p) GROUP BY 1, 2)
 SELECT CAST(s.i - 1 AS INTEGER) AS iter, CAST(q - 1 AS INTEGER) AS cluster, coalesce(h.n, 0) AS n, CAST(j AS INTEGER) AS pos, round(s.cs[q][j], 9) AS value FROM s CROSS JOIN (SELECT unnest(range(1, {K + 1})) AS q) CROSS JOIN (SELECT unnest(range(1, 65)) AS j) LEFT JOIN h ON h.i = s.i - 1 AND h.k = q WHERE s.i > 0 AND mv >= 1e-4""")
def k4(spark, d):
    p, start = points(spark, d)
    h = kmeans.history_vectors(p, kmeans.fit_vectors(p, "x", start))
    return h.select("iter", "cluster", "n", F.posexplode("centroid").alias("pos", "value")).select("iter", "cluster", "n", (F.col("pos") + 1).alias("pos"), F.round("value", 9).alias("value"))


@query("k5_cluster_vs_label", f"WITH RECURSIVE {K_END} SELECT cluster, label, count(*) AS n FROM z GROUP BY 1, 2")
def k5(spark, d):
    p, start = points(spark, d)
    return kmeans.cluster_vs_label(kmeans.fit_vectors(p, "x", start).labels, "label")


# --- Naive Bayes -------------------------------------------------------------

BITS = ["f0", "f1", "f2", "f3"]
NB = "(SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_discount > 0.04 AS INTEGER) AS f0, CAST(l_tax > 0.03 AS INTEGER) AS f1, CAST(l_quantity > 25 AS INTEGER) AS f2, CAST(l_extendedprice > 30000 AS INTEGER) AS f3 FROM lineitem)"
NBM = f"m AS (SELECT y AS c, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem) AS prior, " + ", ".join(f"(sum({b}) + 1) / (count(*) + 2) AS p{i}" for i, b in enumerate(BITS)) + f" FROM {NB} t GROUP BY 1)"


def nb_table(spark, d):
    flag = lambda e: F.expr(e).cast("int")
    return table(spark, d, "lineitem").select(flag("l_returnflag = 'R'").alias("y"), flag("l_discount > 0.04").alias("f0"), flag("l_tax > 0.03").alias("f1"), flag("l_quantity > 25").alias("f2"), flag("l_extendedprice > 30000").alias("f3"))


def _predicted(bernoulli: bool) -> str:
    terms = " + ".join(f"{b} * ln(p{i})" + (f" + (1 - {b}) * ln(1 - p{i})" if bernoulli else "") for i, b in enumerate(BITS))
    return f"WITH {NBM}, t AS (SELECT y, f0, f1, f2, f3, count(*) AS n FROM {NB} t GROUP BY ALL), s AS (SELECT t.*, c, round(ln(prior) + {terms}, 12) AS s FROM t, m) SELECT y, pred, CAST(sum(n) AS BIGINT) AS n FROM (SELECT y, f0, f1, f2, f3, any_value(n) AS n, max_by(c, row(s, -c)) AS pred FROM s GROUP BY y, f0, f1, f2, f3) GROUP BY 1, 2"


@query("b1_nb_fit", f"WITH {NBM} SELECT c AS class, n, round(prior, 9) AS prior, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3 FROM m")
def b1(spark, d):
    m = naive_bayes.nb_fit(nb_table(spark, d), BITS, "y")
    return m.select("class", "n", F.round("prior", 9).alias("prior"), *[F.round(F.get("likelihood", F.lit(i)), 9).alias(f"p{i}") for i in range(4)])


@query("b2_nb_predict", _predicted(False))
def b2(spark, d):
    t = nb_table(spark, d)
    return naive_bayes.nb_predict(t, naive_bayes.nb_fit(t, BITS, "y"), BITS).groupBy("y", "pred").agg(F.count("*").alias("n"))


@query("b3_nb_bernoulli", _predicted(True))
def b3(spark, d):
    t = nb_table(spark, d)
    return naive_bayes.nb_predict(t, naive_bayes.nb_fit(t, BITS, "y"), BITS, "bernoulli").groupBy("y", "pred").agg(F.count("*").alias("n"))


# --- trees -------------------------------------------------------------------

LEAF = 5
FEATURES = ["p_size", "p_retailprice"]
PARTS = "(SELECT p_partkey, CAST(p_size AS DOUBLE) AS f0, p_retailprice AS f1, CASE WHEN p_size * 37 + CAST(p_retailprice AS BIGINT) % 97 > 1000 THEN 'b' WHEN p_retailprice < 1300 THEN 'a' ELSE 'c' END AS y FROM part)"


def parts(spark, d):
    y = F.when(F.col("p_size") * 37 + F.rint("p_retailprice").cast("long") % 97 > 1000, "b").when(F.col("p_retailprice") < 1300, "a").otherwise("c")
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", y.alias("y"), F.lit(1).alias("node"))


_G = " + ".join(f"power({{0}}_{c} / {{0}}, 2)" for c in "abc")
CAND = f"""t AS {PARTS}, u AS (SELECT 0 AS fi, f0 AS v, y FROM t UNION ALL SELECT 1, f1, y FROM t),
 g AS (SELECT fi, v, count(*) FILTER (y = 'a') AS a, count(*) FILTER (y = 'b') AS b, count(*) FILTER (y = 'c') AS c FROM u GROUP BY 1, 2),
 w AS (SELECT fi, v, lead(v) OVER (PARTITION BY fi ORDER BY v) AS nxt, sum(a) OVER o AS l_a, sum(b) OVER o AS l_b, sum(c) OVER o AS l_c, sum(a) OVER p AS n_a, sum(b) OVER p AS n_b, sum(c) OVER p AS n_c FROM g WINDOW o AS (PARTITION BY fi ORDER BY v), p AS (PARTITION BY fi)),
 x AS (SELECT *, l_a + l_b + l_c AS l, n_a + n_b + n_c AS n, n_a - l_a AS r_a, n_b - l_b AS r_b, n_c - l_c AS r_c, n_a + n_b + n_c - l_a - l_b - l_c AS r FROM w WHERE nxt IS NOT NULL),
 s AS (SELECT fi, (v + nxt) / 2 AS thr, l, r, round((1 - ({_G.format('n')})) - (l / n * (1 - ({_G.format('l')})) + r / n * (1 - ({_G.format('r')}))), 12) AS gain FROM x WHERE l >= {LEAF} AND r >= {LEAF})"""


@query("c1_gini", "WITH c AS (SELECT p_brand, p_size % 3 AS y, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, CAST(sum(n) AS BIGINT) AS n, round(1 - sum(n * n) / (sum(n) * sum(n)), 9) AS gini FROM c GROUP BY 1")
def c1(spark, d):
    g = tree.gini(table(spark, d, "part").withColumn("y", F.col("p_size") % 3), ["p_brand"], "y")
    return g.withColumn("gini", F.round("gini", 9))


@query("c2_best_split", f"WITH {CAND} SELECT CASE fi WHEN 0 THEN 'p_size' ELSE 'p_retailprice' END AS feature, round(thr, 6) AS thr, round(gain, 9) AS gain, CAST(l AS BIGINT) AS n_left, CAST(r AS BIGINT) AS n_right FROM s WHERE gain > 0 ORDER BY s.gain DESC, fi, s.thr LIMIT 1")
def c2(spark, d):
    b = tree.best_split(parts(spark, d), "node", FEATURES, "y", ["a", "b", "c"], LEAF)
    return b.select("feature", F.round("thr", 6).alias("thr"), F.round("gain", 9).alias("gain"), F.col("n_left").cast("long").alias("n_left"), F.col("n_right").cast("long").alias("n_right"))


DEPTH = 4


def _cart(depth: int, rows: str = PARTS, features: int = 2, classes: str = "abc", leaf: int = LEAF) -> str:
    """Chained CTEs: t0 .. tn (rows with their node at each level), b0 .. (the splits made there), all splits b and the labels of all nodes."""
    each = lambda form, sep=", ": sep.join(form.format(c) for c in classes)
    pick = "CASE fi " + " ".join(f"WHEN {j} THEN f{j}" for j in range(features)) + " END"
    loss = lambda n: f"(1 - ({each(f'power({n}_{{0}} / {n}, 2)', ' + ')}))"
    out = [f"t0 AS MATERIALIZED (SELECT *, 1 AS node FROM {rows})"]
    for i in range(depth):
        out += [
            f"u{i} AS (" + " UNION ALL ".join(f"SELECT node, {j} AS fi, CAST(f{j} AS DOUBLE) AS v, y FROM t{i}" for j in range(features)) + ")",
            f"g{i} AS (SELECT node, fi, v, {each("count(*) FILTER (y = '{0}') AS c_{0}")} FROM u{i} GROUP BY 1, 2, 3)",
            f"w{i} AS (SELECT node, fi, v, lead(v) OVER (PARTITION BY node, fi ORDER BY v) AS nxt, {each('sum(c_{0}) OVER o AS l_{0}, sum(c_{0}) OVER p AS n_{0}')} FROM g{i} WINDOW o AS (PARTITION BY node, fi ORDER BY v), p AS (PARTITION BY node, fi))",
            f"x{i} AS (SELECT *, {each('l_{0}', ' + ')} AS l, {each('n_{0}', ' + ')} AS n, {each('n_{0} - l_{0} AS r_{0}')}, {each('n_{0} - l_{0}', ' + ')} AS r FROM w{i} WHERE nxt IS NOT NULL)",
            f"s{i} AS (SELECT node, fi, (v + nxt) / 2 AS thr, l, r, round({loss('n')} - (l / n * {loss('l')} + r / n * {loss('r')}), 12) AS gain FROM x{i} WHERE l >= {leaf} AND r >= {leaf})",
            f"b{i} AS MATERIALIZED (SELECT node, fi, thr, gain FROM s{i} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, fi, thr) = 1)",
            f"t{i + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node), CASE WHEN fi IS NULL THEN t.node WHEN ({pick}) < thr THEN 2 * t.node ELSE 2 * t.node + 1 END AS node FROM t{i} t LEFT JOIN b{i} b ON b.node = t.node)",
        ]
    out.append("b AS (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(depth)) + ")")
    out.append("cnt AS (" + " UNION ".join(f"SELECT node, y, count(*) AS n FROM t{i} GROUP BY 1, 2" for i in range(depth + 1)) + ")")
    out.append("lab AS (SELECT node, max_by(y, row(n, -ascii(y))) AS pred, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY 1)")
    return ", ".join(out)


CART = _cart(DEPTH)


_NODES = """ SELECT CAST(lab.node AS BIGINT) AS node_id, CAST(floor(log2(lab.node)) AS INTEGER) AS depth, b.node IS NULL AS is_leaf, pred, CASE fi WHEN 0 THEN 'p_size' WHEN 1 THEN 'p_retailprice' END AS feature, round(thr, 6) AS thr, round(gain, 9) AS gain, n,
 CASE WHEN b.node IS NOT NULL THEN CAST(2 * b.node AS BIGINT) END AS left_id, CASE WHEN b.node IS NOT NULL THEN CAST(2 * b.node + 1 AS BIGINT) END AS right_id FROM lab LEFT JOIN b ON b.node = lab.node"""


def nodes(spark, d, depth: int):
    p = parts(spark, d)
    return tree.tree_fit(p, FEATURES, "y", depth, LEAF).table(p).withColumns({"thr": F.round("thr", 6), "gain": F.round("gain", 9)})


@query("c3_tree_fit", f"WITH {CART}" + _NODES)
def c3(spark, d):
    return nodes(spark, d, DEPTH)


@query("c3_tree_fit_deep", f"WITH {_cart(DEPTH + 2)}" + _NODES)
def c3d(spark, d):
    return nodes(spark, d, DEPTH + 2)


@query("c4_tree_predict", f"WITH {CART} SELECT p_partkey, pred FROM t{DEPTH} JOIN lab USING (node)")
def c4(spark, d):
    p = parts(spark, d)
    return tree.tree_predict(p, tree.tree_fit(p, FEATURES, "y", DEPTH, LEAF)).select("p_partkey", "pred")


@query("c5_tree_accuracy", f"WITH {CART} SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM t{DEPTH} JOIN lab USING (node)")
def c5(spark, d):
    p = parts(spark, d)
    return tree.tree_accuracy(p, tree.tree_fit(p, FEATURES, "y", DEPTH, LEAF), "y").withColumn("accuracy", F.round("accuracy", 9))


_DOWN = ", ".join(f"r{i + 1} AS (SELECT gx, gy, CASE WHEN fi IS NULL THEN r.node WHEN (CASE fi WHEN 0 THEN gx ELSE gy END) < thr THEN 2 * r.node ELSE 2 * r.node + 1 END AS node FROM r{i} r LEFT JOIN b{i} b ON b.node = r.node)" for i in range(DEPTH))


@query("c6_grid_predict", f"""WITH {CART}, e AS (SELECT min(f0) - 1 AS x0, max(f0) + 1 AS x1, min(f1) - 1 AS y0, max(f1) + 1 AS y1 FROM t0),
 r0 AS (SELECT x0 + j * ((x1 - x0) / 299) AS gx, y0 + i * ((y1 - y0) / 299) AS gy, 1 AS node FROM e, (SELECT unnest(range(300)) AS i), (SELECT unnest(range(300)) AS j)), {_DOWN}
 SELECT pred, count(*) AS n FROM r{DEPTH} JOIN lab USING (node) GROUP BY 1""")
def c6(spark, d):
    p = parts(spark, d)
    return tree.grid_predict(p, tree.tree_fit(p, FEATURES, "y", DEPTH, LEAF), *FEATURES).groupBy("pred").agg(F.count("*").alias("n"))


@query("c7_label_change_split", f"""WITH t AS {PARTS}, g AS (SELECT f1 AS v, y, count(*) AS k FROM t GROUP BY 1, 2),
 w AS (SELECT v, y, lead(v) OVER o AS v2, lead(y) OVER o AS y2, sum(CASE WHEN y = 'a' THEN k ELSE 0 END) OVER o AS l_a, sum(CASE WHEN y = 'b' THEN k ELSE 0 END) OVER o AS l_b, sum(CASE WHEN y = 'c' THEN k ELSE 0 END) OVER o AS l_c,
 sum(CASE WHEN y = 'a' THEN k ELSE 0 END) OVER () AS n_a, sum(CASE WHEN y = 'b' THEN k ELSE 0 END) OVER () AS n_b, sum(CASE WHEN y = 'c' THEN k ELSE 0 END) OVER () AS n_c FROM g WINDOW o AS (ORDER BY v, y)),
 x AS (SELECT *, l_a + l_b + l_c AS l, n_a + n_b + n_c AS n, n_a - l_a AS r_a, n_b - l_b AS r_b, n_c - l_c AS r_c, n_a + n_b + n_c - l_a - l_b - l_c AS r FROM w WHERE y2 <> y),
 s AS (SELECT v, y, (v + v2) / 2 AS thr, l, r, round((1 - ({_G.format('n')})) - (l / n * (1 - ({_G.format('l')})) + r / n * (1 - ({_G.format('r')}))), 12) AS gain FROM x WHERE l >= 5 AND r >= 5)
 SELECT round(max_by(thr, row(gain, -v, -l)), 6) AS thr, round(max(gain), 9) AS gain, round(max_by(gain, row(v, y)), 9) AS last_gain, CAST(max_by(l, row(v, y)) AS BIGINT) AS last_left, CAST(max_by(r, row(v, y)) AS BIGINT) AS last_right, count(*) AS n_candidates FROM s""")
def c7(spark, d):
    r = tree.label_change_split(parts(spark, d), "p_retailprice", "y", 5)
    return r.select(F.round("thr", 6).alias("thr"), F.round("gain", 9).alias("gain"), F.round("last_gain", 9).alias("last_gain"), F.col("last_left").cast("long").alias("last_left"), F.col("last_right").cast("long").alias("last_right"), "n_candidates")


C8_DEPTH = 3
#: Balance and segment (its first value left out) against a class that follows both, with rows that break the rule.
C8 = "(SELECT c_custkey AS k, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN 'a' WHEN c_acctbal > 6000 THEN 'b' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal < -300 THEN 'c' ELSE 'a' END AS y FROM customer)"
C8_PARTS = f"""cs AS {C8}, sg AS (SELECT s, row_number() OVER (ORDER BY s) AS j FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)),
 q AS (SELECT y AS c, floor(round(count(*) * 0.2, 9)) AS q, round(count(*) * 0.2, 9) - floor(round(count(*) * 0.2, 9)) AS r, count(*) AS n FROM cs GROUP BY 1),
 z AS (SELECT c, q + CASE WHEN row_number() OVER (ORDER BY r DESC, c) <= (SELECT ceil(round(sum(n) * 0.2, 9)) - sum(q) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
 ft AS (SELECT k, cs.y, c_acctbal AS f0, {", ".join(f"CAST(j = {j + 1} AS INTEGER) AS f{j}" for j in range(1, 5))}, row_number() OVER (PARTITION BY cs.y ORDER BY md5('42|' || k)) <= quota AS is_test FROM cs JOIN sg ON s = c_mktsegment JOIN z ON c = cs.y),
 {_cart(C8_DEPTH, "(SELECT * FROM ft WHERE NOT is_test)", 5, "abc", 1)},
 d0 AS (SELECT *, 1 AS node FROM ft), {", ".join(f"d{i + 1} AS (SELECT d.* EXCLUDE (node), CASE WHEN fi IS NULL THEN d.node WHEN (CASE fi WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END) < thr THEN 2 * d.node ELSE 2 * d.node + 1 END AS node FROM d{i} d LEFT JOIN b{i} b ON b.node = d.node)" for i in range(C8_DEPTH))},
 pr AS (SELECT d{C8_DEPTH}.y, is_test, lab.pred FROM d{C8_DEPTH} JOIN lab USING (node))"""


@query("c8_tree_classifier", f"""WITH {C8_PARTS} SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, NULL AS actual, NULL AS predicted, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM pr GROUP BY 1
 UNION ALL SELECT 'confusion', a.c, p.c, NULL, (SELECT count(*) FROM pr WHERE is_test AND y = a.c AND pred = p.c) FROM q a, q p""")
def c8(spark, d):
    y = F.expr("CASE WHEN c_custkey % 11 = 0 THEN 'a' WHEN c_acctbal > 6000 THEN 'b' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal < -300 THEN 'c' ELSE 'a' END")
    x = encode.dummies(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", y.alias("y")).dropna(), ["c_mktsegment"])
    s = split.stratified_split(x, "y", "c_custkey")
    made = tree.tree_classifier(s.where("not is_test"), s.where("is_test"), [n for n in x.columns if n not in ("c_custkey", "y")], "y", C8_DEPTH)
    none = F.lit(None).cast("string")
    return made.scores.select("part", none.alias("actual"), none.alias("predicted"), F.round("accuracy", 9).alias("accuracy"), "n").union(made.confusion.select(F.lit("confusion"), "actual", "predicted", F.lit(None).cast("double"), "n"))


# --- regression --------------------------------------------------------------

LIN = "(SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS x, 2 * ((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()) + 1 + (o_custkey % 7 - 3) * 0.1 AS y FROM orders)"
MOM = f"m AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM {LIN} t)"
GD = f"WITH RECURSIVE {MOM}, g AS (SELECT 0 AS e, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b UNION ALL SELECT e + 1, w - 0.02 * (w * sxx + b * sx - sxy) / n, b - 0.02 * (w * sx + b * n - sy) / n FROM g, m WHERE e < 300)"


def lin(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("x"))
    return scale.standardize(o, ["x"]).withColumn("y", 2 * F.col("x") + 1 + (F.col("o_custkey") % 7 - 3) * 0.1)


@query("l1_linear_predict", f"SELECT o_orderkey, round(2 * x + 1, 6) AS pred FROM {LIN} t")
def l1(spark, d):
    return linear.linear_predict(lin(spark, d), ["x"], [2.0], 1.0).select("o_orderkey", F.round("pred", 6).alias("pred"))


@query("l2_fit_gd", GD + " SELECT round(w, 6) AS w, round(b, 6) AS b FROM g WHERE e = 300")
def l2(spark, d):
    f = linear.fit_gd(lin(spark, d), ["x"], "y", 0.01, 300)
    return spark.createDataFrame([(round(f.weights[0], 6), round(f.bias, 6))], "w double, b double")


@query("l3_fit_adam", f"""WITH RECURSIVE {MOM}, g AS (SELECT 0 AS e, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS mw, CAST(0 AS DOUBLE) AS mb, CAST(0 AS DOUBLE) AS vw, CAST(0 AS DOUBLE) AS vb
 UNION ALL SELECT e, w - 0.01 * (mw / (1 - power(0.9, e))) / (sqrt(vw / (1 - power(0.999, e))) + 1e-8), b - 0.01 * (mb / (1 - power(0.9, e))) / (sqrt(vb / (1 - power(0.999, e))) + 1e-8), mw, mb, vw, vb FROM
 (SELECT e + 1 AS e, w, b, 0.9 * mw + 0.1 * gw AS mw, 0.9 * mb + 0.1 * gb AS mb, 0.999 * vw + 0.001 * gw * gw AS vw, 0.999 * vb + 0.001 * gb * gb AS vb FROM (SELECT g.*, 2 * (w * sxx + b * sx - sxy) / n AS gw, 2 * (w * sx + b * n - sy) / n AS gb FROM g, m WHERE e < 200)))
 SELECT round(w, 6) AS w, round(b, 6) AS b FROM g WHERE e = 200""")
def l3(spark, d):
    f = linear.fit_adam(lin(spark, d), ["x"], "y", 0.01, 200)
    return spark.createDataFrame([(round(f.weights[0], 6), round(f.bias, 6))], "w double, b double")


@query("l4_loss_history", GD + " SELECT e + 1 AS epoch, round((w * w * sxx + 2 * w * b * sx + b * b * n - 2 * w * sxy - 2 * b * sy + syy) / n, 6) AS loss FROM g, m WHERE (e + 1) % 100 = 0 AND e < 300")
def l4(spark, d):
    x = lin(spark, d)
    return linear.loss_history(x, linear.fit_gd(x, ["x"], "y", 0.01, 300)).withColumn("loss", F.round("loss", 6))


@query("l5_evaluate_linear", GD + f", z AS (SELECT w, b FROM g WHERE e = 300), q AS (SELECT round(avg(power(w * x + b - y, 2)), 6) AS mse FROM {LIN} t, z) SELECT 'w_x' AS name, round(w, 6) AS learned, CAST(2 AS DOUBLE) AS expected, mse FROM z, q UNION ALL SELECT 'bias', round(b, 6), CAST(1 AS DOUBLE), mse FROM z, q")
def l5(spark, d):
    x = lin(spark, d)
    e = linear.evaluate_linear(x, ["x"], "y", linear.fit_gd(x, ["x"], "y", 0.01, 300), [2.0], 1.0)
    return e.select("name", F.round("learned", 6).alias("learned"), "expected", F.round("mse", 6).alias("mse"))


# --- networks ----------------------------------------------------------------

W1 = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(4)] for i in range(3)]
B1 = [0.05, -0.05, 0.1]
HID = [f"greatest(0, {B1[i]}" + "".join(f" + ({W1[i][j]}) * CAST(embedding[{j + 1}] AS DOUBLE)" for j in range(4)) + ")" for i in range(3)]


@query("n1_dense_relu", "SELECT vec_id, " + ", ".join(f"round({h}, 9) AS h{i}" for i, h in enumerate(HID)) + " FROM embeddings")
def n1(spark, d):
    h = network.relu(network.dense(F.slice("embedding", 1, 4), W1, B1))
    e = table(spark, d, "embeddings").select("vec_id", h.alias("h"))
    return e.select("vec_id", *[F.round(F.get("h", F.lit(i)), 9).alias(f"h{i}") for i in range(3)])


@query("n2_softmax_argmax", "SELECT vec_id, " + ", ".join(f"round(exp({h}) / ({' + '.join(f'exp({x})' for x in HID)}), 9) AS s{i}" for i, h in enumerate(HID)) + f", CASE WHEN {HID[0]} >= greatest({HID[1]}, {HID[2]}) THEN 0 WHEN {HID[1]} >= {HID[2]} THEN 1 ELSE 2 END AS best FROM embeddings")
def n2(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", network.relu(network.dense(F.slice("embedding", 1, 4), W1, B1)).alias("h"))
    e = e.select("vec_id", network.softmax(F.col("h")).alias("s"), network.argmax(F.col("h")).alias("best"))
    return e.select("vec_id", *[F.round(F.get("s", F.lit(i)), 9).alias(f"s{i}") for i in range(3)], "best")


@query("n3_score_mlp", "SELECT vec_id, round(0.2" + "".join(f" + {w} * {h}" for w, h in zip((0.5, -0.25, 1.0), HID)) + ", 9) AS y FROM embeddings")
def n3(spark, d):
    layers = [(np.array(W1), np.array(B1)), (np.array([[0.5, -0.25, 1.0]]), np.array([0.2]))]
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("x"))
    return network.score_mlp(e, "x", layers).select("vec_id", F.round(F.get("logits", F.lit(0)), 9).alias("y"))


def _cnn():
    rng = np.random.default_rng(5)
    convs = [(rng.normal(0, 0.3, (4, 1, 3, 3)), np.zeros(4)), (rng.normal(0, 0.3, (8, 4, 3, 3)), np.zeros(8))]
    return convs, [(rng.normal(0, 0.3, (10, 32)), np.zeros(10))]


def _cnn_sql() -> str:
    """Every block as a join of pixels with the weights' table."""
    convs, ((w, _),) = _cnn()
    ctes, source, side = [], "(SELECT vec_id, 0 AS c, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS p))", 8
    for i, (k, _) in enumerate(convs):
        values = ", ".join(f"({o}, {c}, {dy - 1}, {dx - 1}, ({float(k[o, c, dy, dx])!r})::DOUBLE)" for o, c, dy, dx in np.ndindex(*k.shape))
        ctes.append(f"k{i}(o, c, dy, dx, w) AS (VALUES {values})")
        ctes.append(f"z{i} AS MATERIALIZED (SELECT vec_id, o, p.y - dy AS y, p.x - dx AS x, greatest(0, sum(w * p.v)) AS v FROM {source} p JOIN k{i} k ON k.c = p.c AND p.y - dy BETWEEN 0 AND {side - 1} AND p.x - dx BETWEEN 0 AND {side - 1} GROUP BY 1, 2, 3, 4)")
        ctes.append(f"m{i} AS MATERIALIZED (SELECT vec_id, o AS c, y // 2 AS y, x // 2 AS x, max(v) AS v FROM z{i} GROUP BY 1, 2, 3, 4)")
        source, side = f"m{i}", side // 2
    values = ", ".join(f"({o}, {j}, ({float(w[o, j])!r})::DOUBLE)" for o, j in np.ndindex(*w.shape))
    ctes.append(f"d(o, j, w) AS (VALUES {values}), l AS (SELECT vec_id, o, sum(w * v) AS v FROM {source} p JOIN d ON j = c * {side * side} + y * {side} + x GROUP BY 1, 2)")
    return "WITH " + ", ".join(ctes) + " SELECT vec_id, CAST(max_by(o, v) AS INTEGER) AS best, round(max(v), 6) AS top FROM l GROUP BY 1"


@query("n4_score_cnn", _cnn_sql())
def n4(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    out = network.score_cnn(e, "x", (1, 8, 8), *_cnn())
    return out.select("vec_id", network.argmax(F.col("logits")).alias("best"), F.round(F.array_max("logits"), 6).alias("top"))


def _regression(spark, d):
    """All 64 components against a sum of them."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", x.alias("x"), (F.get("embedding", F.lit(0)).cast("double") * 1.5 - F.get("embedding", F.lit(1)).cast("double") * 2 + F.get("embedding", F.lit(63)).cast("double")).alias("y"))


@query("n5_train_mlp")
def n5(spark, d):
    e = split.assign_batches(_regression(spark, d), "vec_id", 64)
    _, losses = network.train_mlp(e, "x", "y", network.init_layers([64, 16, 1]), epochs=10, batch="batch_id")
    return spark.createDataFrame([(i + 1, float(round(x, 6))) for i, x in enumerate(losses)], "epoch int, loss double")


N5_EPOCHS, N5_RATE = 20, 0.5
_N5 = network.init_layers([64, 1])[0]
#: One layer by full batches: with the row (x, 1) the gradient is 2 (G w - c) / n, G the sum of products of rows and c of rows and targets.
N5 = f"""WITH RECURSIVE r AS (SELECT list_append(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), CAST(1 AS DOUBLE)) AS x, CAST(embedding[1] AS DOUBLE) * 1.5 - CAST(embedding[2] AS DOUBLE) * 2 + CAST(embedding[64] AS DOUBLE) AS y FROM embeddings),
 g AS (SELECT i, j, sum(x[i] * x[j]) AS v FROM r, (SELECT unnest(range(1, 66)) AS i), (SELECT unnest(range(1, 66)) AS j) GROUP BY 1, 2),
 m AS (SELECT (SELECT list(q ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS q FROM g GROUP BY i)) AS g, (SELECT list(c ORDER BY i) FROM (SELECT i, sum(x[i] * y) AS c FROM r, (SELECT unnest(range(1, 66)) AS i) GROUP BY i)) AS c, (SELECT sum(y * y) FROM r) AS yy, (SELECT count(*) FROM r) AS n),
 s AS (SELECT 0 AS e, CAST([{", ".join(repr(float(v)) for v in [*_N5[0].ravel(), *_N5[1]])}] AS DOUBLE[]) AS w
  UNION ALL SELECT e + 1, list_transform(range(1, 66), lambda i: w[i] - {N5_RATE} * 2 * (list_dot_product(g[i], w) - c[i]) / n) FROM s, m WHERE e < {N5_EPOCHS})
 SELECT 'loss' AS kind, e + 1 AS i, round((list_dot_product(list_transform(range(1, 66), lambda k: list_dot_product(g[k], w)), w) - 2 * list_dot_product(w, c) + yy) / n, 6) AS v FROM s, m WHERE e < {N5_EPOCHS}
 UNION ALL SELECT 'weight', CAST(i AS INTEGER), round(w[i], 6) FROM s, (SELECT unnest(range(1, 66)) AS i) WHERE e = {N5_EPOCHS}"""


@query("n5_train_linear", N5)
def n5_linear(spark, d):
    layers, losses = network.train_mlp(_regression(spark, d), "x", "y", [_N5], optimizer="sgd", lr=N5_RATE, epochs=N5_EPOCHS)
    rows = [("loss", i + 1, float(x)) for i, x in enumerate(losses)] + [("weight", i + 1, float(x)) for i, x in enumerate([*layers[0][0].ravel(), *layers[0][1]])]
    return spark.createDataFrame(rows, "kind string, i int, v double").withColumn("v", F.round("v", 6))


@query("n6_parameter_count", """WITH s AS (SELECT max(len(embedding)) AS d, count(DISTINCT label) AS k FROM embeddings)
 SELECT layer, CAST(sum(n) AS BIGINT) AS n_params FROM (SELECT 0 AS layer, d * 16 + 16 AS n FROM s UNION ALL SELECT 1, 16 * k + k FROM s) GROUP BY GROUPING SETS ((layer), ())""")
def n6(spark, d):
    n = table(spark, d, "embeddings").agg(F.max(F.size("embedding")).alias("d"), F.countDistinct("label").alias("k")).first()
    path = scratch(spark)
    network.save_model(spark, network.init_layers([n["d"], 16, n["k"]]), path)
    return network.parameter_count(network.model_sizes(spark.read.parquet(path)))

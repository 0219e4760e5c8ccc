"""Queries of sources, profiling, encoding, splits, scaling, metrics and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, matrix, metrics, profile, scale, split
from ..sources import images, synthetic, tables
from .registry import query, scratch, table


# --- sources and sinks -------------------------------------------------------


@query("s1_read_headerless_csv", "SELECT p_partkey, p_size, round(p_retailprice, 4) AS p_retailprice FROM part")
def s1(spark, d):
    path = scratch(spark)
    tables.write_feature_csv(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), path, header=False)
    return tables.read_headerless_csv(spark, path, "p_partkey long, p_size int, p_retailprice double").withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("s2_read_feature_csv", "SELECT p_partkey, CAST(p_size AS FLOAT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part")
def s2(spark, d):
    path = scratch(spark)
    tables.write_feature_csv(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), path)
    return tables.read_feature_csv(spark, path, "p_partkey double, p_size double, p_retailprice double").withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("s3_write_feature_csv", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, round(sum(c_acctbal), 2) AS balance FROM customer")
def s3(spark, d):
    path = scratch(spark)
    tables.write_feature_csv(table(spark, d, "customer").select("c_custkey", "c_acctbal"), path)
    return spark.read.csv(path, header=True, schema="c_custkey long, c_acctbal double").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("s4_image_table", """SELECT vec_id AS image_id, 8 AS height, 8 AS width, 1 AS channels,
 CAST(list_sum(list_transform(embedding, lambda x: least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 127.5))))) AS BIGINT) AS total FROM embeddings""")
def s4(spark, d):
    path = scratch(spark)
    images.write_images(images.vector_images(table(spark, d, "embeddings")), path)
    v = images.read_images(spark, path).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))
    return v.withColumn("total", F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + x)).drop("data", "path")


@query("s5_load_annotated_images", "SELECT vec_id AS path, label, CASE WHEN label = 9 THEN 'missing' ELSE 'found' END AS status, CASE WHEN label = 9 THEN NULL ELSE 64 END AS n_pixels, CASE WHEN label = 9 THEN NULL ELSE CAST(list_sum(list_transform(embedding, lambda x: least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 127.5))))) AS BIGINT) END AS total FROM embeddings")
def s5(spark, d):
    """Every vector is annotated; those with label 9 have no picture file."""
    e, path = table(spark, d, "embeddings"), scratch(spark)
    images.write_images(images.vector_images(e.where("label <> 9")), path)
    got = images.load_annotated_images(e.select(F.concat("vec_id", F.lit(".png")).alias("path"), "label"), path)
    total = F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + x)
    return got.all.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("path"), "label", "status", F.when(F.col("data").isNotNull(), F.size("data")).alias("n_pixels"), total.alias("total"))


@query("s6_write_read_model", "SELECT l_returnflag AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS prior FROM lineitem GROUP BY 1")
def s6(spark, d):
    from ..operators.naive_bayes import nb_fit

    path = scratch(spark)
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") > 0).cast("int").alias("x"))
    tables.write_model(nb_fit(li, ["x"], "l_returnflag"), path)
    return tables.read_model(spark, path).select("class", "n", F.round("prior", 9).alias("prior"))


def _draw(seed: int, tag: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|{tag}|' || {key}), 1, 15) AS BIGINT)"


def _normal(seed: int, tag: str, key: str) -> str:
    u = lambda x: f"((CAST({_draw(seed, tag + x, key)} AS DOUBLE) + 1) / CAST({16**15} AS DOUBLE))"
    return f"sqrt(-2 * ln({u('u')})) * cos(2 * pi() * {u('v')})"


CENTERS = [[-4.0, 1.0], [0.5, 6.0], [5.0, -3.0]]


@query("s7_make_blobs", f"SELECT p_partkey, y, " + ", ".join(f"round(CASE y {' '.join(f'WHEN {k} THEN {c[j]}' for k, c in enumerate(CENTERS))} END + 3 * {_normal(10, f'x{j}', 'p_partkey')}, 6) AS x{j}" for j in (0, 1)) + f" FROM (SELECT p_partkey, CAST({_draw(10, 'y', 'p_partkey')} % 3 AS INTEGER) AS y FROM part) p")
def s7(spark, d):
    return synthetic.make_blobs(table(spark, d, "part"), "p_partkey", CENTERS).withColumns({c: F.round(c, 6) for c in ("x0", "x1")})


@query("s8_make_linear", f"SELECT p_partkey, round(f0, 6) AS feature_0, round(f1, 6) AS feature_1, round(f2, 6) AS feature_2, round(1.5 * f0 - 2 * f1 + 0.5 * f2 + 0.8 + 0.1 * e, 6) AS target FROM (SELECT p_partkey, {', '.join(f'{_normal(0, f"f{j}", "p_partkey")} AS f{j}' for j in range(3))}, {_normal(0, 'noise', 'p_partkey')} AS e FROM part) p")
def s8(spark, d):
    x = synthetic.make_linear(table(spark, d, "part"), "p_partkey", [1.5, -2.0, 0.5], 0.8)
    return x.withColumns({c: F.round(c, 6) for c in x.columns[1:]})


@query("s9_make_random_images", f"SELECT vec_id AS image_id, CAST({_draw(0, 'label', 'vec_id')} % 3 AS INTEGER) AS label, round(list_sum(list_transform(range(192), lambda i: CAST(CAST('0x' || substr(md5('0|' || vec_id || '|' || i), 1, 15) AS BIGINT) AS DOUBLE) / CAST({16**15} AS DOUBLE))) / 192, 6) AS mean FROM embeddings")
def s9(spark, d):
    p = synthetic.make_random_images(table(spark, d, "embeddings"), "vec_id", size=8)
    return p.select("image_id", "label", F.round(F.aggregate("image", F.lit(0.0), lambda a, x: a + x) / F.size("image"), 6).alias("mean"))


# --- profiling ---------------------------------------------------------------

HOLES = "(SELECT p_partkey, p_brand, CASE WHEN p_size % 17 = 0 THEN NULL ELSE p_size END AS p_size, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)"


def holes(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 17 != 0, F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice")).alias("p_retailprice"))


@query("p1_head", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def p1(spark, d):
    return profile.head(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("p2_profile", "WITH h AS (SELECT * FROM " + HOLES + " t) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows, 4 AS n_columns FROM h" for c, t in (("p_partkey", "bigint"), ("p_brand", "string"), ("p_size", "int"), ("p_retailprice", "double"))))
def p2(spark, d):
    return profile.profile(holes(spark, d))


@query("p3_null_counts", "WITH h AS (SELECT * FROM " + HOLES + " t) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM h" for c in ("p_partkey", "p_brand", "p_size", "p_retailprice")))
def p3(spark, d):
    return profile.null_counts(holes(spark, d))


@query("p4_drop_missing", "SELECT * FROM " + HOLES + " t WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def p4(spark, d):
    return profile.drop_missing(holes(spark, d))


@query("p5_split_features_target", "SELECT 'features' AS part, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part UNION ALL SELECT 'target', count(*), CAST(sum(p_size) AS DOUBLE) FROM part")
def p5(spark, d):
    x, y = profile.split_features_target(table(spark, d, "part"), ["p_partkey", "p_retailprice"], "p_size")
    return x.agg(F.lit("features").alias("part"), F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total")).union(y.agg(F.lit("target"), F.count("*"), F.sum("p_size").cast("double")))


@query("p6_dummies", """WITH v AS (SELECT DISTINCT c_mktsegment AS s FROM customer), r AS (SELECT s, row_number() OVER (ORDER BY s) AS k FROM v)
 SELECT c_custkey, CAST(sum(CASE WHEN k > 1 AND c_mktsegment = s THEN k ELSE 0 END) AS BIGINT) AS code, CAST(sum(CASE WHEN k > 1 AND c_mktsegment = s THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM customer CROSS JOIN r GROUP BY c_custkey""")
def p6(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    out = encode.dummies(c, ["c_mktsegment"])
    made = [x for x in out.columns if x != "c_custkey"]
    code = sum((F.col(f"`{x}`") * (k + 2) for k, x in enumerate(made)), F.lit(0))
    return out.select("c_custkey", code.cast("long").alias("code"), sum((F.col(f"`{x}`") for x in made), F.lit(0)).cast("long").alias("ones"))


@query("p7_one_hot", "SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(i = label AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(10)) AS i)")
def p7(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(encode.one_hot("label", 10)).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query("p8_index_labels", "SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx, n FROM (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1)")
def p8(spark, d):
    return encode.index_labels(table(spark, d, "customer"), "c_mktsegment").withColumn("idx", F.col("idx").cast("long"))


@query("p9_label_names", "SELECT vec_id, 'class ' || label AS name FROM embeddings")
def p9(spark, d):
    return encode.label_names(table(spark, d, "embeddings"), {i: f"class {i}" for i in range(10)}, "label").select("vec_id", "name")


@query("p10_binarize", "SELECT CAST(l_discount > 0 AS INTEGER) AS l_discount, CAST(l_tax > 0 AS INTEGER) AS l_tax, count(*) AS n FROM lineitem GROUP BY 1, 2")
def p10(spark, d):
    return profile.binarize(table(spark, d, "lineitem"), ["l_discount", "l_tax"]).groupBy("l_discount", "l_tax").agg(F.count("*").alias("n"))


@query("p11_hconcat", "SELECT c_custkey, c_acctbal, p_retailprice FROM customer JOIN part ON c_custkey = p_partkey")
def p11(spark, d):
    return profile.hconcat(table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "part").select("p_partkey", "p_retailprice"), "c_custkey", "p_partkey").drop("p_partkey")


@query("p12_apply_transform", "SELECT p_partkey, p_size * 2 + 1 AS p_size, upper(p_brand) AS p_brand FROM part WHERE p_size > 10")
def p12(spark, d):
    chain = profile.compose(lambda x: x.where("p_size > 10"), lambda x: profile.apply_transform(x, {"p_size": lambda c: c * 2}, {"p_brand": F.upper}), lambda x: profile.apply_transform(x, {"p_size": lambda c: c + 1}))
    return chain(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"))


# --- splits ------------------------------------------------------------------

RANKED = "(SELECT *, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS rk, count(*) OVER () AS n FROM orders)"


@query("d1_train_test_split", f"SELECT o_orderkey, rk <= ceil(round(n * 0.2, 9)) AS is_test FROM {RANKED} t")
def d1(spark, d):
    return split.train_test_split(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "is_test")


@query("d2_stratified_split", """WITH q AS (SELECT o_orderpriority AS c, floor(round(count(*) * 0.2, 9)) AS q, round(count(*) * 0.2, 9) - floor(round(count(*) * 0.2, 9)) AS r, count(*) AS n FROM orders GROUP BY 1),
 m AS (SELECT ceil(round(sum(n) * 0.2, 9)) - sum(q) AS m FROM q), k AS (SELECT c, q, row_number() OVER (ORDER BY r DESC, c) AS k FROM q),
 z AS (SELECT c, q + CASE WHEN k <= m THEN 1 ELSE 0 END AS quota FROM k, m),
 o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey)) AS rk FROM orders)
 SELECT o_orderkey, o_orderpriority, rk <= quota AS is_test FROM o JOIN z ON o_orderpriority = c""")
def d2(spark, d):
    return split.stratified_split(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "is_test")


@query("d3_permutation_split", f"SELECT o_orderkey, rk <= floor(round(n * 0.8, 9)) AS is_train FROM {RANKED} t")
def d3(spark, d):
    return split.permutation_split(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "is_train")


@query("d4_sample_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey) LIMIT 100")
def d4(spark, d):
    return split.sample_k(table(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query("d5_sample_with_replacement", f"SELECT draw, o_orderkey FROM (SELECT i AS draw, CAST('0x' || substr(md5('42|draw|' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM orders) + 1 AS want FROM (SELECT unnest(range(500)) AS i)) JOIN {RANKED} t ON want = rk")
def d5(spark, d):
    return split.sample_with_replacement(table(spark, d, "orders"), "o_orderkey", 500).select("draw", "o_orderkey")


@query("d6_assign_batches", f"SELECT o_orderkey, (rk - 1) // 64 AS batch_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS source_batch FROM {RANKED} t")
def d6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    a = split.assign_batches(o, "o_orderkey", 64)
    return a.join(split.assign_batches(o, "o_orderkey", 64, shuffle=False).withColumnRenamed("batch_id", "source_batch"), "o_orderkey")


@query("d7_batch_shapes", f"SELECT (rk - 1) // 64 AS batch_id, count(*) AS n_rows FROM {RANKED} t WHERE (rk - 1) // 64 < 3 GROUP BY 1")
def d7(spark, d):
    return split.batch_shapes(split.assign_batches(table(spark, d, "orders"), "o_orderkey", 64))


# --- scaling -----------------------------------------------------------------

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
Z = "(SELECT " + ", ".join(f"({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END) AS {c}" for c in NUM) + " FROM lineitem)"


@query("t1_standardize", "SELECT " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in NUM) + f" FROM {Z} z")
def t1(spark, d):
    z = scale.standardize(table(spark, d, "lineitem").select(*NUM), NUM)
    return z.select(*[(F.round(c, 6) + 0.0).alias(c) for c in NUM])


@query("t2_fit_apply_scaler", f"WITH s AS (SELECT *, rk <= ceil(round(n * 0.2, 9)) AS is_test FROM {RANKED} t), m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM s WHERE NOT is_test) SELECT o_orderkey, is_test, round((o_totalprice - m.m) / m.s, 6) AS z FROM s, m")
def t2(spark, d):
    s = split.train_test_split(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "is_test", F.col("o_totalprice").alias("z"))
    return scale.apply_scaler(s, scale.fit_scaler(s.where("not is_test"), ["z"]), ["z"]).withColumn("z", F.round("z", 6))


@query("t3_normalize_const", "SELECT p_partkey, round((p_size - 25.0) / 14.0, 9) AS p_size, round((p_retailprice - 1500.0) / 300.0, 9) AS p_retailprice FROM part")
def t3(spark, d):
    p = scale.normalize_const(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": 25.0, "p_retailprice": 1500.0}, {"p_size": 14.0, "p_retailprice": 300.0})
    return p.select("p_partkey", F.round("p_size", 9).alias("p_size"), F.round("p_retailprice", 9).alias("p_retailprice"))


@query("t4_covariance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem" for a in NUM for b in NUM))
def t4(spark, d):
    return scale.covariance(table(spark, d, "lineitem"), NUM).withColumn("cov", F.round("cov", 4))


@query("t4_covariance_wide", """SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_samp(CAST(embedding[i] AS DOUBLE), CAST(embedding[j] AS DOUBLE)), 9) AS cov FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j""")
def t4_wide(spark, d):
    m = scale.covariance_matrix(table(spark, d, "embeddings"), "embedding", 64)
    return spark.createDataFrame([(i + 1, j + 1, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "i int, j int, cov double").withColumn("cov", F.round("cov", 9))


# --- metrics -----------------------------------------------------------------

EV = "(SELECT doc_id, quality AS y, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE greatest(quality, toxic) END AS pred FROM labels)"


def ev(spark, d):
    p = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.greatest("quality", "toxic"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), p.alias("pred"))


@query("e1_accuracy", f"SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM {EV} t")
def e1(spark, d):
    return metrics.accuracy(ev(spark, d), "y", "pred").withColumn("accuracy", F.round("accuracy", 9))


@query("e2_confusion_matrix", f"SELECT a AS actual, b AS predicted, count(y) AS n FROM (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b) LEFT JOIN {EV} t ON y = a AND pred = b GROUP BY 1, 2")
def e2(spark, d):
    return metrics.confusion_matrix(ev(spark, d), "y", "pred").select(F.col("actual").cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted"), "n")


@query("e3_classification_report", f"""WITH c AS (SELECT k, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (y = k) AS s, count(*) FILTER (pred = k) AS g FROM {EV} t, (SELECT unnest([0, 1]) AS k) GROUP BY k),
 p AS (SELECT k, tp, s, coalesce(tp / nullif(g, 0), 0) AS pr, coalesce(tp / nullif(s, 0), 0) AS re FROM c), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM p)
 SELECT CAST(k AS VARCHAR) AS label, round(pr, 9) AS precision, round(re, 9) AS recall, round(f1, 9) AS f1, s AS support FROM f
 UNION ALL SELECT 'accuracy', round(sum(tp) / sum(s), 9), round(sum(tp) / sum(s), 9), round(sum(tp) / sum(s), 9), CAST(sum(s) AS BIGINT) FROM f
 UNION ALL SELECT 'macro avg', round(avg(pr), 9), round(avg(re), 9), round(avg(f1), 9), CAST(sum(s) AS BIGINT) FROM f
 UNION ALL SELECT 'weighted avg', round(sum(pr * s) / sum(s), 9), round(sum(re * s) / sum(s), 9), round(sum(f1 * s) / sum(s), 9), CAST(sum(s) AS BIGINT) FROM f""")
def e3(spark, d):
    r = metrics.classification_report(ev(spark, d), "y", "pred")
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("e4_per_class_accuracy", f"SELECT y AS label, round(100 * avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM {EV} t GROUP BY 1")
def e4(spark, d):
    return metrics.per_class_accuracy(ev(spark, d), "y", "pred").withColumn("accuracy", F.round("accuracy", 9))


@query("e5_mse", "SELECT round(avg((l_extendedprice / 1000 - l_quantity) * (l_extendedprice / 1000 - l_quantity)), 6) AS mse FROM lineitem")
def e5(spark, d):
    return metrics.mse(table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000), "l_quantity", "p").withColumn("mse", F.round("mse", 6))


@query("e6_cross_entropy", "SELECT round(avg(ln(list_sum(list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE))))) - CAST(embedding[label + 1] AS DOUBLE)), 9) AS loss FROM embeddings")
def e6(spark, d):
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").agg(F.round(F.avg(metrics.cross_entropy(z, F.col("label"))), 9).alias("loss"))


@query("e7_bce_with_logits", "SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 9) AS loss FROM (SELECT CAST(embedding[1] AS DOUBLE) AS z, CAST(label % 2 AS DOUBLE) AS y FROM embeddings)")
def e7(spark, d):
    return table(spark, d, "embeddings").agg(F.round(F.avg(metrics.bce_with_logits(F.get("embedding", F.lit(0)).cast("double"), (F.col("label") % 2).cast("double"))), 9).alias("loss"))


BATCH = "(SELECT vec_id // 64 AS batch_id, abs(CAST(embedding[1] AS DOUBLE)) AS loss, label % 3 = 0 AS correct FROM embeddings)"


def batches(spark, d):
    return table(spark, d, "embeddings").select(F.expr("vec_id div 64").alias("batch_id"), F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("loss"), (F.col("label") % 3 == 0).alias("correct"))


@query("e8_batched_loss", f"WITH b AS (SELECT batch_id, avg(loss) AS l, count(*) FILTER (correct) AS c, count(*) AS n FROM {BATCH} t GROUP BY 1) SELECT round(avg(l), 9) AS loss, round(sum(c) / sum(n), 9) AS accuracy, count(*) AS n_batches FROM b")
def e8(spark, d):
    r = metrics.batched_loss(batches(spark, d), "batch_id", "loss", "correct")
    return r.select(F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"), "n_batches")


@query("e9_running_loss", f"WITH b AS (SELECT batch_id, avg(loss) AS l FROM {BATCH} t GROUP BY 1), n AS (SELECT count(*) AS n FROM b) SELECT batch_id // 3 AS \"window\", round(avg(l), 9) AS mean_loss, count(*) AS n_batches, (SELECT round(sum(CASE WHEN batch_id >= n // 3 * 3 THEN l ELSE 0 END) / max(n), 9) FROM b, n) AS epoch_loss FROM b GROUP BY 1")
def e9(spark, d):
    b = batches(spark, d)
    r = metrics.running_loss(b, "batch_id", "loss", every=3).crossJoin(F.broadcast(metrics.epoch_loss(b, "batch_id", "loss", every=3).select(F.round("epoch_loss", 9).alias("epoch_loss"))))
    return r.withColumn("mean_loss", F.round("mean_loss", 9))


# --- matrices ----------------------------------------------------------------

M = "(SELECT vec_id AS i, CAST(p AS BIGINT) AS j, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS p))"


def mat(spark, d):
    return matrix.from_rows(table(spark, d, "embeddings"), "vec_id", "embedding")


def r6(m):
    return m.withColumn("v", F.round("v", 6) + 0.0)


@query("m0_from_rows", f"SELECT i, j, round(v, 6) + 0.0 AS v FROM {M} m")
def m0(spark, d):
    return r6(mat(spark, d))


@query("m1_fill_eye_like", f"SELECT 'eye' AS kind, i, j, CAST(i = j AS DOUBLE) AS v FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) UNION ALL SELECT 'like', i, j, CAST(7 AS DOUBLE) FROM {M} m")
def m1(spark, d):
    return matrix.eye(spark, 64).select(F.lit("eye").alias("kind"), "i", "j", "v").union(matrix.like(mat(spark, d), 7.0).select(F.lit("like"), "i", "j", "v"))


@query("m2_elementwise", f"SELECT i, j, round((v + 10) * (v + 10) * v * 10, 6) + 0.0 AS v FROM {M} m")
def m2(spark, d):
    a = mat(spark, d)
    return r6(matrix.hadamard(matrix.elementwise(a, lambda v: F.pow(v + 10, 2)), matrix.elementwise(a, lambda v: v * 10)))


@query("m3_matmul", f"SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {M} a JOIN {M} b ON a.i = b.i GROUP BY 1, 2")
def m3(spark, d):
    a = mat(spark, d)
    return r6(matrix.matmul(matrix.transpose(a), a))


@query("m3_matmul_blocks", f"SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {M} a JOIN {M} b ON a.i = b.i GROUP BY 1, 2")
def m3b(spark, d):
    a = mat(spark, d)
    return r6(matrix.matmul_blocks(matrix.transpose(a), a))


@query("m4_index", f"SELECT i, j, round(v, 6) + 0.0 AS v FROM {M} m WHERE i >= 10 AND j >= 5 AND j < 9")
def m4(spark, d):
    return r6(matrix.index(mat(spark, d), (10, 2**62), (5, 9)))


@query("m5_assign_column", f"SELECT i, j, CASE WHEN j = 1 THEN 0.0 ELSE round(v, 6) + 0.0 END AS v FROM {M} m")
def m5(spark, d):
    return r6(matrix.assign_column(mat(spark, d), 1, 0.0))


@query("m6_transpose", f"SELECT j AS i, i AS j, round(v, 6) + 0.0 AS v FROM {M} m")
def m6(spark, d):
    return r6(matrix.transpose(mat(spark, d)))


@query("m7_reshape", f"SELECT (i * 64 + j) // 16 AS i, (i * 64 + j) % 16 AS j, round(v, 6) + 0.0 AS v FROM {M} m")
def m7(spark, d):
    return r6(matrix.reshape(mat(spark, d), 64, 16))


@query("m8_concat", f"SELECT i, j, round(v, 6) + 0.0 AS v FROM {M} m UNION ALL SELECT i, j + 64, round(v, 6) + 0.0 FROM {M} m")
def m8(spark, d):
    a = mat(spark, d)
    return r6(matrix.concat_columns(a, a, 64))


@query("m9_sum", f"SELECT round(sum(v), 6) AS total FROM {M} m")
def m9(spark, d):
    return matrix.total(mat(spark, d)).withColumn("total", F.round("total", 6))

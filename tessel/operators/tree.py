"""Exact decision trees (CART, gini), grown level by level.

Values are dealt into ordered ranges once: Spark's mergeable quantile sketch, one per
feature in one aggregate, gives cuts that are even in rows whatever the values'
distribution, and their number follows the table. A node holds no more rows of a
range than the root does, so the cuts serve every level.

One job a level finds the best split of every open node. Its first aggregate counts
classes per (node, feature, range), which makes the gains at the borders of ranges
exact and bounds the gains inside: moving one row from right to left changes
sum(l_i^2) / l + sum(r_i^2) / r by at most 2. Only ranges whose bound reaches the
node's best border are searched value by value. The splits carry the class counts of
both sides, so no other job counts the children.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .encode import MAX_CATEGORIES, categories
from .metrics import confusion_matrix
from .ranking import quantile_ranges


def gini(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, n, gini): 1 - sum p^2 per group."""
    c = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    return c.groupBy(*by).agg(n.alias("n"), (1 - F.sum(F.col("_n") * F.col("_n")) / (n * n)).alias("gini"))


def _impurity(counts: list[Column], n: Column) -> Column:
    return F.when(n > 0, 1 - sum((F.pow(c / n, 2) for c in counts), F.lit(0.0))).otherwise(F.lit(0.0))


RANGE_ROWS = 20_000  # rows of a range, about
LEAST_RANGES, MOST_RANGES = 64, 4_096


def feature_cuts(df: DataFrame, features: list[str], n: int) -> list[list[float]]:
    """Ascending cut values of each feature, from one aggregate of sketches; about RANGE_ROWS rows lie between two."""
    k = max(LEAST_RANGES, min(MOST_RANGES, n // RANGE_ROWS))
    at = [i / k for i in range(1, k)]
    one = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10 * k).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(c or [])) for c in one]


def ranged(df: DataFrame, features: list[str], label: str, classes: list, cuts: list[list[float]], keep: list[str] = ()) -> DataFrame:
    """(y: place of the class, v: values, b: range of each value, -1 for null) of the rows that have a class."""
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    d = df.where(F.col(label).isNotNull()).select(*keep, y.alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))

    def place(i: int, c: list[float]) -> str:
        """The number of cuts up to the value, found by halving steps."""
        steps = ", ".join(str(2**j) for j in range(len(c).bit_length() - 1, -1, -1))
        array = "array(" + ", ".join(f"double('{x!r}')" for x in c) + ")"
        return f"IF(v[{i}] IS NULL, -1, aggregate(array({steps}), 0, (at, step) -> IF(get({array}, at + step - 1) <= v[{i}], at + step, at)))" if c else f"IF(v[{i}] IS NULL, -1, 0)"

    return d.selectExpr(*keep, "y", "v", f"array({', '.join(place(i, c) for i, c in enumerate(cuts))}) AS b")


def _gain(left: list[str], every: list[str]) -> str:
    """SQL of the gain of parting the counts ``every`` into ``left`` and the rest, to 12 places."""
    right = [f"({a} - {c})" for a, c in zip(every, left)]
    size = lambda x: "(" + " + ".join(x) + ")"

    def loss(x: list[str]) -> str:
        return f"IF({size(x)} > 0, 1D - (" + " + ".join(f"pow({c} / {size(x)}, 2)" for c in x) + "), 0D)"

    return f"round({loss(every)} - ({size(left)} / {size(every)} * {loss(left)} + {size(right)} / {size(every)} * {loss(right)}), 12)"


def split_candidates(data: DataFrame, k: int, min_leaf: int) -> DataFrame:
    """(node, fidx, thr, gain, n_left, n_right, left: counts per class) of every candidate of ``data`` (node, y, v, b) that may be its node's best."""
    each = lambda form, sep=", ": sep.join(form.format(i) for i in range(k))
    columns = lambda name: [f"{name}{i}" for i in range(k)]
    long = data.selectExpr("node", "y", "posexplode(arrays_zip(b, v)) AS (fidx, z)").selectExpr("node", "y", "fidx", "z.b AS b", "z.v AS value").where("b >= 0")
    counts = [F.expr(f"count_if(y = {i}) AS c{i}") for i in range(k)]
    cells = long.groupBy("node", "fidx", "b").agg(*counts, F.expr("min(value) AS lo"), F.expr("max(value) AS hi"))
    # Windows over the ranges of a (node, feature), small as the counts are: s starts and e ends a range, a is the node.
    cells = cells.repartition("node")
    w = "(PARTITION BY node, fidx ORDER BY b)"
    cells = cells.selectExpr("*", *[f"sum(c{i}) OVER {w} AS e{i}" for i in range(k)], *[f"sum(c{i}) OVER (PARTITION BY node, fidx) AS a{i}" for i in range(k)], f"lead(lo) OVER {w} AS after")
    cells = cells.selectExpr("*", *[f"e{i} - c{i} AS s{i}" for i in range(k)], f"{each('a{}', ' + ')} AS n", f"{each('c{}', ' + ')} AS m", f"{each('e{}', ' + ')} AS n_left")
    cells = cells.selectExpr("*", f"{_gain(columns('e'), columns('a'))} AS gain", f"{_gain(columns('s'), columns('a'))} AS before").withColumn("bound", F.expr("(before + gain) / 2 + m / n"))
    valid = f"after IS NOT NULL AND n_left >= {min_leaf} AND n - n_left >= {min_leaf} AND gain > 0"
    cells = cells.withColumn("best", F.expr(f"coalesce(max(CASE WHEN {valid} THEN gain END) OVER (PARTITION BY node), 0D)"))
    borders = cells.where(f"{valid} AND gain >= best").selectExpr("node", "fidx", "(hi + after) / 2 AS thr", "gain", "n_left", "n - n_left AS n_right", f"array({each('e{}')}) AS left")
    inside = cells.where(f"hi > lo AND bound >= best - 1e-9 AND n_left > {min_leaf} AND n - n_left + m > {min_leaf}").selectExpr("node", "fidx", "b", f"struct({each('s{}')}, {each('a{}')}) AS t")
    per = long.join(inside, ["node", "fidx", "b"]).groupBy("node", "fidx", "b", "value", "t").agg(*counts)
    w = "(PARTITION BY node, fidx, b ORDER BY value)"
    per = per.selectExpr("node", "fidx", "value", f"lead(value) OVER {w} AS after", "t.*", *[f"t.s{i} + sum(c{i}) OVER {w} AS l{i}" for i in range(k)]).where("after IS NOT NULL")
    per = per.selectExpr("*", f"{each('l{}', ' + ')} AS n_left", f"{each('a{}', ' + ')} AS n").where(f"n_left >= {min_leaf} AND n - n_left >= {min_leaf}")
    found = per.selectExpr("node", "fidx", "(value + after) / 2 AS thr", f"{_gain(columns('l'), columns('a'))} AS gain", "n_left", "n - n_left AS n_right", f"array({each('l{}')}) AS left")
    return borders.union(found.where("gain > 0"))


def best_splits(data: DataFrame, k: int, min_leaf: int) -> DataFrame:
    """(node, fidx, thr, gain, n_left, n_right, left): the best candidate per node: largest gain, then the first feature, then the lowest threshold; gains of 0 don't count."""
    best = F.expr("max_by(struct(fidx, thr, gain, n_left, n_right, left), struct(gain, -fidx, -thr)) AS s")
    return split_candidates(data, k, min_leaf).groupBy("node").agg(best).select("node", "s.*")


def best_split(df: DataFrame, node: str, features: list[str], label: str, classes: list, min_leaf: int = 5) -> DataFrame:
    """(node, feature, thr, gain, n_left, n_right) of the best split of each node of ``df``."""
    n = df.count()
    data = ranged(df.withColumn("_node", F.col(node)), features, label, classes, feature_cuts(df, features, n), ["_node"]).withColumnRenamed("_node", "node")
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("fidx"))
    return best_splits(data, len(classes), min_leaf).select(F.col("node").alias(node), name.alias("feature"), "thr", "gain", "n_left", "n_right")


@dataclass
class Tree:
    """Node table rows by node_id (root 1, children 2i and 2i + 1): depth, is_leaf, pred, feature, thr, gain, n."""

    nodes: dict[int, dict]

    def table(self, like: DataFrame, pred_type: str = "string") -> DataFrame:
        rows = [(i, r["depth"], r["is_leaf"], r["pred"], r["feature"], r["thr"], r["gain"], r["n"], None if r["is_leaf"] else 2 * i, None if r["is_leaf"] else 2 * i + 1) for i, r in sorted(self.nodes.items())]
        return like.sparkSession.createDataFrame(rows, f"node_id long, depth int, is_leaf boolean, pred {pred_type}, feature string, thr double, gain double, n long, left_id long, right_id long")

    def expression(self, at: int = 1) -> Column:
        r = self.nodes[at]
        if r["is_leaf"]:
            return F.lit(r["pred"])
        return F.when(F.col(r["feature"]) < F.lit(r["thr"]), self.expression(2 * at)).otherwise(self.expression(2 * at + 1))


def tree_fit(df: DataFrame, features: list[str], label: str, max_depth: int = 4, min_leaf: int = 5) -> Tree:
    """Grow until the depth is reached, a node is pure or no split gains; majority class, the lower one on ties; left is x < thr.

    A level is one job of all open nodes; at most 2^depth rows of splits reach the
    driver. Rows find their node by the splits as a nested condition, so nothing but
    the cached values is read again at each level.
    """
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).limit(MAX_CATEGORIES + 1).collect()}
    if len(counts) > MAX_CATEGORIES:
        raise ValueError(f"{label} has more than {MAX_CATEGORIES} distinct values")
    classes = sorted(counts)
    root = [counts[c] for c in classes]
    tree = Tree({1: _leaf(0, root, classes)})
    if len(classes) < 2 or not max_depth:
        return tree
    data = ranged(df, features, label, classes, feature_cuts(df.where(F.col(label).isNotNull()), features, sum(root))).persist()
    inside = {1: root}

    def place(at: int = 1) -> Column:
        r = tree.nodes[at]
        return F.lit(at).cast("long") if r["is_leaf"] else F.when(F.get("v", F.lit(features.index(r["feature"]))) < F.lit(r["thr"]), place(2 * at)).otherwise(place(2 * at + 1))

    for depth in range(max_depth):
        open_ = sorted(i for i, c in inside.items() if sum(x > 0 for x in c) > 1)
        if not open_:
            break
        found, grown = best_splits(data.withColumn("node", place()).where(F.col("node").isin(open_)), len(classes), min_leaf).collect(), {}
        for r in found:
            i = r["node"]
            tree.nodes[i] |= {"is_leaf": False, "feature": features[r["fidx"]], "thr": r["thr"], "gain": r["gain"]}
            # Rows without a value go right.
            grown[2 * i], grown[2 * i + 1] = list(r["left"]), [a - b for a, b in zip(inside[i], r["left"])]
            for child in (2 * i, 2 * i + 1):
                tree.nodes[child] = _leaf(depth + 1, grown[child], classes)
        inside = grown
    data.unpersist()
    return tree


def _leaf(depth: int, counts: list[int], classes: list) -> dict:
    top = max(counts, default=0)
    pred = next((c for c, n in zip(classes, counts) if n == top), None)
    return {"depth": depth, "is_leaf": True, "pred": pred, "feature": None, "thr": None, "gain": None, "n": sum(counts)}


def tree_predict(df: DataFrame, tree: Tree, out: str = "pred") -> DataFrame:
    return df.withColumn(out, tree.expression())


def tree_accuracy(df: DataFrame, tree: Tree, label: str) -> DataFrame:
    return tree_predict(df, tree).agg(F.avg((F.col("pred") == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def grid_predict(df: DataFrame, tree: Tree, fx: str, fy: str, steps: int = 300, margin: float = 1.0) -> DataFrame:
    """Class of each cell of an even grid from the smallest value - margin to the largest + margin."""
    r = df.agg(F.min(fx), F.max(fx), F.min(fy), F.max(fy)).first()
    lo_x, hi_x, lo_y, hi_y = (float(v) for v in r)

    def at(i: Column, lo: float, hi: float) -> Column:
        return F.lit(lo - margin) + i * F.lit((hi - lo + 2 * margin) / (steps - 1))

    cells = df.sparkSession.range(steps * steps).select(F.expr(f"id div {steps}").alias("i"), (F.col("id") % steps).alias("j"))
    cells = cells.withColumn(fx, at(F.col("j"), lo_x, hi_x)).withColumn(fy, at(F.col("i"), lo_y, hi_y))
    return tree_predict(cells, tree)


def label_change_split(df: DataFrame, feature: str, label: str, min_leaf: int = 5) -> DataFrame:
    """Scan of one feature with candidates only where neighbouring rows differ in their label.

    Rows are ordered by value and label; equal values may be parted, as neighbours
    are rows. One row: the best threshold and gain (the first of equal ones), and
    the gain and sizes of the last candidate. Equal (value, label) rows are one
    group here: a label can change only between groups, which keeps the ordered
    scan as small as the number of distinct pairs. The groups are dealt into
    ordered ranges; a range's scan starts from the totals of those before it and
    ends at the first group of the next, so no task holds all of them.
    """
    g = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("double").alias("v"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    classes = categories(df, label)
    k = len(classes)
    d = quantile_ranges(g, "v").withColumns({f"c{i}": F.when(F.col("y") == F.lit(c), F.col("n")).otherwise(0) for i, c in enumerate(classes)})
    ranges = d.groupBy("_r").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in range(k)], F.min(F.struct("v", "y")).alias("_first"))
    w, every = W.partitionBy(F.lit(1)).orderBy("_r"), W.partitionBy(F.lit(1))  # at most RANGES rows
    ranges = ranges.select("_r", F.lead("_first").over(w).alias("_next"), *[(F.sum(f"t{i}").over(w) - F.col(f"t{i}")).alias(f"b{i}") for i in range(k)], *[F.sum(f"t{i}").over(every).alias(f"a{i}") for i in range(k)])
    inner = W.partitionBy("_r").orderBy("v", "y")
    after = F.coalesce(F.lead(F.struct("v", "y")).over(inner), F.col("_next")).alias("after")
    d = d.join(F.broadcast(ranges), "_r").select("v", "y", after, *[(F.col(f"b{i}") + F.sum(f"c{i}").over(inner)).alias(f"l{i}") for i in range(k)], *[f"a{i}" for i in range(k)])
    d = d.select("*", F.col("after.v").alias("v2"), F.col("after.y").alias("y2"))
    left, right, al = [F.col(f"l{i}") for i in range(k)], [F.col(f"a{i}") - F.col(f"l{i}") for i in range(k)], [F.col(f"a{i}") for i in range(k)]
    nl, nr, n = sum(left, F.lit(0)), sum(right, F.lit(0)), sum(al, F.lit(0))
    gain = _impurity(al, n) - (nl / n * _impurity(left, nl) + nr / n * _impurity(right, nr))
    c = d.where((F.col("y2") != F.col("y")) & (nl >= min_leaf) & (nr >= min_leaf)).select(((F.col("v") + F.col("v2")) / 2).alias("thr"), F.round(gain, 12).alias("gain"), nl.alias("nl"), nr.alias("nr"), "v", "y")
    best = F.max_by(F.struct("thr", "gain"), F.struct("gain", -F.col("v"), nl_order()))
    last = F.max_by(F.struct("gain", "nl", "nr"), F.struct("v", "y"))
    return c.agg(best.alias("b"), last.alias("z"), F.count("*").alias("n_candidates")).select(F.col("b.thr").alias("thr"), F.col("b.gain").alias("gain"), F.col("z.gain").alias("last_gain"), F.col("z.nl").alias("last_left"), F.col("z.nr").alias("last_right"), "n_candidates")


def nl_order() -> Column:
    return -F.col("nl")


@dataclass
class Classified:
    tree: Tree
    scores: DataFrame  # (part, accuracy, n) of train and test
    confusion: DataFrame  # (label, pred, n) of test, all pairs of classes


def tree_classifier(train: DataFrame, test: DataFrame, features: list[str], label: str, max_depth: int = 3) -> Classified:
    """A tree of ``train`` with its accuracy on both parts and the confusion table of ``test``."""
    tree = tree_fit(train, features, label, max_depth, min_leaf=1)
    score = tree_accuracy(train, tree, label).select(F.lit("train").alias("part"), "accuracy", "n").union(tree_accuracy(test, tree, label).select(F.lit("test"), "accuracy", "n"))
    return Classified(tree, score, confusion_matrix(tree_predict(test, tree), label, "pred"))

"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import MAX_CATEGORIES, categories


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, y: str, pred: str, labels: list | None = None) -> DataFrame:
    """(actual, predicted, n) over all label pairs, zeros kept."""
    labels = labels if labels is not None else sorted({*categories(df, y), *categories(df, pred)})
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], ["actual", "predicted"])
    counts = df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support), then accuracy, macro avg and weighted avg; 0 where a division has no ground."""
    # One pass over the rows; a pair of labels each reaches the driver.
    found = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n")).limit(MAX_CATEGORIES**2 + 1).collect()
    labels = sorted({r["actual"] for r in found} | {r["predicted"] for r in found})
    if len(labels) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} labels")
    if not found:
        return df.sparkSession.createDataFrame([], "label string, precision double, recall double, f1 double, support long")
    cm = df.sparkSession.createDataFrame([tuple(r) for r in found] + [(a, a, 0) for a in labels], ["actual", "predicted", "n"])
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = cm.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), tp.alias("tp"))
    cols = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("got"))
    per = rows.join(cols, "label").withColumn("precision", part(F.col("tp"), F.col("got"))).withColumn("recall", part(F.col("tp"), F.col("support")))
    per = per.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    acc = part(F.sum("tp"), F.sum("support"))
    out = per.select(F.col("label").cast("string").alias("label"), *names, "support")
    out = out.union(per.agg(F.lit("accuracy"), *[acc for _ in names], F.sum("support")))
    out = out.union(per.agg(F.lit("macro avg"), *[F.avg(c) for c in names], F.sum("support")))
    return out.union(per.agg(F.lit("weighted avg"), *[part(F.sum(F.col(c) * F.col("support")), F.sum("support")) for c in names], F.sum("support")))


def per_class_accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("label")).agg((100 * F.avg((F.col(y) == F.col(pred)).cast("double"))).alias("accuracy"), F.count("*").alias("n"))


def mse(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(pred) - F.col(y), 2)).alias("mse"))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax at the label, shifted by the largest logit."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda z: F.exp(z - top)), F.lit(0.0), lambda a, x: a + x)
    return F.log(total) + top - F.get(logits, label)


def bce_with_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log(1 + F.exp(-F.abs(z)))


def batched_loss(df: DataFrame, batch: str, loss: str, correct: str) -> DataFrame:
    """Mean over batches of the batches' mean loss (a short batch weighs the same); accuracy over rows."""
    per = df.groupBy(batch).agg(F.avg(loss).alias("_l"), F.sum(F.col(correct).cast("long")).alias("_c"), F.count("*").alias("_n"))
    return per.agg(F.avg("_l").alias("loss"), (F.sum("_c") / F.sum("_n")).alias("accuracy"), F.count("*").alias("n_batches"))


def running_loss(df: DataFrame, batch: str, loss: str, every: int = 100) -> DataFrame:
    """(window, mean_loss, n_batches) per ``every`` batches."""
    per = df.groupBy(batch).agg(F.avg(loss).alias("_l"))
    return per.groupBy(F.expr(f"`{batch}` div {every}").alias("window")).agg(F.avg("_l").alias("mean_loss"), F.count("*").alias("n_batches"))


def epoch_loss(df: DataFrame, batch: str, loss: str, every: int = 100, leftover_only: bool = True) -> DataFrame:
    """Epoch loss. By default only the batches since the last full window count, over all batches' number: the running sum is reset at each report. ``leftover_only=False``: the plain mean."""
    per = df.groupBy(batch).agg(F.avg(loss).alias("_l"))
    n = per.agg(F.count("*").alias("_n"))
    d = per.crossJoin(F.broadcast(n))
    kept = F.when(F.col(batch) >= F.expr(f"_n div {every} * {every}"), F.col("_l")).otherwise(0.0) if leftover_only else F.col("_l")
    return d.agg((F.sum(kept) / F.max("_n")).alias("epoch_loss"), F.max("_n").alias("n_batches"))

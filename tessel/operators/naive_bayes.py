"""Bernoulli Naive Bayes on 0/1 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nb_fit(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(class, n, prior, likelihood): n_c / n and (sum x + 1) / (n_c + 2), from one aggregate by class."""
    per = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"), F.array(*[(F.sum(c) + 1) / (F.count("*") + 2) for c in cols]).alias("likelihood"))
    return per.withColumn("prior", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).select("class", "n", "prior", "likelihood")


def nb_predict(df: DataFrame, model: DataFrame, cols: list[str], mode: str = "present") -> DataFrame:
    """Add ``pred``: the class of the highest score, the lower one on ties.

    ``present``: only features that are 1 add to the score. ``bernoulli``:
    absent ones add ln(1 - p) too. Classes x features numbers become literals.
    """
    import math

    scores = []
    for r in sorted(model.collect(), key=lambda r: r["class"]):
        s = F.lit(math.log(r["prior"]))
        for c, p in zip(cols, r["likelihood"]):
            s = s + F.col(c) * F.lit(math.log(p))
            if mode == "bernoulli":
                s = s + (1 - F.col(c)) * F.lit(math.log(1 - p))
        scores.append(F.struct(F.round(s, 12).alias("s"), F.lit(-len(scores)).alias("o"), F.lit(r["class"]).alias("class")))
    return df.withColumn("pred", F.array_max(F.array(*scores))["class"])

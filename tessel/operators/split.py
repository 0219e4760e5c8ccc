"""Reproducible splits, samples and batches: every choice is md5 of a seed and a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import draw, draw_number, global_rank, ordered_rank


def train_test_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: true for ceil(test * n) rows."""
    n = df.agg(F.count("*").alias("_n"))
    ranked = global_rank(df, draw(seed, key)).crossJoin(F.broadcast(n))  # one row
    return ranked.withColumn("is_test", F.col("rank") <= F.ceil(F.round(F.col("_n") * F.lit(float(test)), 9))).drop("rank", "_n")


def permutation_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``: true for the first floor(train * n) rows of the permutation."""
    n = df.agg(F.count("*").alias("_n"))
    ranked = global_rank(df, draw(seed, key)).crossJoin(F.broadcast(n))
    return ranked.withColumn("is_train", F.col("rank") <= F.floor(F.round(F.col("_n") * F.lit(float(train)), 9))).drop("rank", "_n")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test`` with the same share per class: floor quotas, then the largest remainders (ties: smaller class) up to ceil(test * n)."""
    per = df.groupBy(F.col(label).alias("_c")).agg(F.count("*").alias("_n"))
    share = F.round(F.col("_n") * F.lit(float(test)), 9)
    per = per.withColumn("_q", F.floor(share)).withColumn("_r", share - F.col("_q"))
    every = W.partitionBy(F.lit(1))  # one row per class
    missing = F.ceil(F.round(F.sum("_n").over(every) * F.lit(float(test)), 9)) - F.sum("_q").over(every)
    per = per.withColumn("_m", missing).withColumn("_k", F.row_number().over(every.orderBy(F.desc("_r"), "_c")))
    quota = per.select("_c", (F.col("_q") + (F.col("_k") <= F.col("_m")).cast("long")).alias("_quota"))
    ranked = global_rank(df, draw(seed, key), within=[label])
    return ranked.join(quota, F.col(label).eqNullSafe(F.col("_c"))).withColumn("is_test", F.col("rank") <= F.col("_quota")).drop("rank", "_c", "_quota")


def sample_k(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k distinct rows; a top-k of each task, no full sort."""
    return df.orderBy(draw(seed, key)).limit(k)


def sample_with_replacement(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k independent draws (``draw`` numbers them) of rows by their rank."""
    spark = df.sparkSession
    n = df.agg(F.count("*").alias("_n"))
    draws = spark.range(k).crossJoin(F.broadcast(n)).select(F.col("id").alias("draw"), (draw_number(draw(seed, F.lit("draw"), F.col("id"))) % F.col("_n") + 1).alias("rank"))
    return draws.join(global_rank(df, draw(seed, key)), "rank").drop("rank")


def assign_batches(df: DataFrame, key: str, size: int, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Add ``batch_id``; the last batch may be short. Unshuffled batches follow the key."""
    ranked = global_rank(df, draw(seed, key)).withColumn("rank", F.col("rank") - 1) if shuffle else ordered_rank(df, key)
    return ranked.withColumn("batch_id", F.expr(f"rank div {size}")).drop("rank")


def batch_shapes(df: DataFrame, first: int = 3) -> DataFrame:
    """Rows of each of the first batches."""
    return df.where(F.col("batch_id") < first).groupBy("batch_id").agg(F.count("*").alias("n_rows"))

"""Profiling, cleaning and projection of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit order."""
    return df.orderBy(*order).limit(n)


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, n_rows, n_columns), one row per column, from one aggregate."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"_{i}").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)])
    return one.select(F.inline(rows), F.col("_n").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, missing): nulls, and NaN in floating columns."""
    def gone(c: str, t: str) -> Column:
        x = F.col(f"`{c}`")
        return x.isNull() | F.isnan(x) if t in ("double", "float") else x.isNull()

    one = df.agg(*[F.count_if(gone(c, t)).alias(f"_{i}") for i, (c, t) in enumerate(df.dtypes)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(df.columns)])))


def drop_missing(df: DataFrame) -> DataFrame:
    return df.dropna(how="any")


def split_features_target(df: DataFrame, features: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    return df.select(*features), df.select(target)


def all_but_last(df: DataFrame) -> tuple[list[str], str]:
    return df.columns[:-1], df.columns[-1]


def binarize(df: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    """1 where a value is above the threshold, else 0 (null too)."""
    return df.withColumns({c: F.coalesce(F.col(c) > threshold, F.lit(False)).cast("int") for c in cols})


def hconcat(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Columns of both tables side by side, by explicit row ids."""
    return a.join(b, F.col(a_id) == F.col(b_id))


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def apply_transform(df: DataFrame, features: dict[str, Callable[[Column], Column]], target: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Column functions per feature and target column; a vectorised pandas_udf is such a function too."""
    return df.withColumns({c: f(F.col(c)) for c, f in {**features, **(target or {})}.items()})

"""Categories as numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ordered_rank

MAX_CATEGORIES = 1_000  # one column is made per category


def categories(df: DataFrame, col: str) -> list:
    """Sorted distinct values (nulls left out); refuses columns that hold too many to be categories."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{col} has more than {MAX_CATEGORIES} distinct values")
    return sorted(r[0] for r in rows)


def dummies(df: DataFrame, cols: list[str], drop_first: bool = True) -> DataFrame:
    """One 0/1 column ``col_value`` per category; a null is 0 everywhere."""
    made = {}
    for c in cols:
        for v in categories(df, c)[1 if drop_first else 0 :]:
            made[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), 1).otherwise(0)
    return df.select(*[F.col(c) for c in df.columns if c not in cols], *[e.alias(n) for n, e in made.items()])


def one_hot(col: str, n: int):
    """Array of n numbers, 1.0 at the label."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col(col)).cast("float"))


def index_labels(df: DataFrame, col: str) -> DataFrame:
    """(value, idx, n): distinct values, their place in sorted order and their count. However many they are, windows stay inside ranges of values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return ordered_rank(counts, "value", "idx").select("value", "n", "idx")


def label_names(df: DataFrame, names: dict[int, str], col: str, out: str = "name") -> DataFrame:
    """Class names by index, from a small map given by the caller."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(col)))

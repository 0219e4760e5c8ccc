"""A dense global rank, ordered ranges and percentiles without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RANGES = 200
SAMPLE = 10_000  # values that bounds of ranges are taken from


def draw(seed: int, *keys: Column | str) -> Column:
    """md5 of seed and key columns: the library's only source of randomness for splits and samples."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).cast("binary"))


def draw_number(hashed: Column) -> Column:
    """A non-negative long from the first 15 hexadecimal digits."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def _dealt(df: DataFrame, hashed: Column, rows: int) -> DataFrame:
    """``df`` with ``_h`` (``hashed``) and ``_b``, as many of its first digits as leave about ``rows`` rows to a bucket: three at least."""
    digits = F.ceil(F.round(F.log(16.0, F.greatest(F.count("*") / rows, F.lit(1.0))), 9)).cast("int")
    size = df.agg(F.greatest(F.lit(3), F.least(F.lit(12), digits)).alias("_digits"))  # one row
    return df.withColumn("_h", hashed).crossJoin(F.broadcast(size)).withColumn("_b", F.expr("substring(_h, 1, _digits)")).drop("_digits")


def global_rank(df: DataFrame, hashed: Column, out: str = "rank", within: list[str] | None = None, rows: int = 250_000) -> DataFrame:
    """Add ``out``: 1-based rank by ``hashed`` (a hex text), inside each group of ``within``.

    First digits deal the rows into ordered, even buckets, whose number follows
    the table: about ``rows`` rows each, 4,096 buckets at least. Rows are ranked
    inside their bucket. Buckets' counts are summed in two steps: under the same
    three digits, and over these (at most 4,096 rows in one place).
    """
    within = within or []
    d = _dealt(df, hashed, rows)
    sizes = d.groupBy(*within, "_b").agg(F.count("*").alias("_n")).withColumn("_p", F.substring("_b", 1, 3))
    tops = sizes.groupBy(*within, "_p").agg(F.sum("_n").alias("_t"))
    tops = tops.withColumn("_top", F.sum("_t").over(W.partitionBy(*within).orderBy("_p")) - F.col("_t")).drop("_t")
    under = F.sum("_n").over(W.partitionBy(*within, "_p").orderBy("_b")) - F.col("_n")
    offsets = _join_groups(sizes.withColumn("_under", under), tops, within, "_p")
    offsets = offsets.select(*within, "_b", (F.col("_top") + F.col("_under")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*within, "_b").orderBy("_h"))
    j = _join_groups(d.withColumn("_in", inside), offsets, within, "_b")
    return j.withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_h", "_b", "_in", "_before")


def _join_groups(left: DataFrame, right: DataFrame, within: list[str], key: str) -> DataFrame:
    """The join on ``within`` and ``key``; groups may be null."""
    on = [left[key] == right[key], *[left[c].eqNullSafe(right[c]) for c in within]]
    j = left.join(right, on)
    for c in [*within, key]:
        j = j.drop(right[c])
    return j


def quantile_ranges(df: DataFrame, value: str, out: str = "_r") -> DataFrame:
    """Add ``out``: which of RANGES ordered ranges, about equal in rows, ``value`` lies in; equal values share one.

    The bounds come from a sketch of bounded size. Being inexact only makes the
    ranges less even, as any bounds cut the values in order.
    """
    bounds = df.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_bounds"))  # one row
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.size(F.filter("_bounds", lambda b: b <= F.col(value)))).drop("_bounds")


def ordered_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Add ``out``: 0-based rank by ``value``, of any type that can be ordered; equal values in any order, nulls last.

    Bounds from a bounded sample of the values cut the rows into RANGES ordered
    ranges, only whose counts meet in one task. A value that is a bound itself
    comes first in its range, so that the rows of a frequent one can be dealt
    into 64 further parts by a hash of the row; only rows equal in all columns stay together.
    """
    sample = df.select(F.col(value).alias("_v")).where("_v is not null").orderBy(F.xxhash64(*df.columns)).limit(SAMPLE)
    some = sample.agg(F.sort_array(F.collect_list("_v")).alias("_s"))  # one row, SAMPLE values at most
    bounds = some.select(F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / RANGES).cast("int"))).alias("_bounds"))
    v = F.col(value)
    d = df.crossJoin(F.broadcast(bounds)).withColumn("_r", F.when(v.isNull(), RANGES).otherwise(F.size(F.filter("_bounds", lambda b: b <= v))))
    first = (F.col("_r") == RANGES) | F.get("_bounds", F.col("_r") - 1).eqNullSafe(v)
    d = d.withColumn("_k", F.when(first, F.pmod(F.xxhash64(*df.columns), F.lit(64))).otherwise(64).cast("int")).drop("_bounds")
    sizes = d.groupBy("_r", "_k").agg(F.count("*").alias("_n"))
    before = sizes.select("_r", "_k", (F.sum("_n").over(W.orderBy("_r", "_k")) - F.col("_n")).alias("_before"))  # at most 65 rows a range
    inside = F.row_number().over(W.partitionBy("_r", "_k").orderBy(value)) - 1
    return d.withColumn("_in", inside).join(F.broadcast(before), ["_r", "_k"]).withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_r", "_k", "_in", "_before")


def percentiles(df: DataFrame, value: str, at: list[float]) -> list[float]:
    """The exact percentiles of a column of doubles, as ``percentile`` defines them; nulls take no part.

    Counts of ordered ranges tell which ranges hold the wanted ranks; values are
    counted and ranked inside these ranges only.
    """
    d = quantile_ranges(df.select(F.col(value).cast("double").alias("_v")).where("_v is not null"), "_v").persist()
    sizes = sorted((r["_r"], r["n"]) for r in d.groupBy("_r").agg(F.count("*").alias("n")).collect())  # at most RANGES rows
    total = sum(n for _, n in sizes)
    if not total:
        raise ValueError(f"{value} has no values")
    places = [p * (total - 1) for p in at]
    wanted, seen = {}, 0  # range -> rows before it, wanted ranks (from 0)
    for r, n in sizes:
        ranks = sorted({k for p in places for k in (int(p // 1), int(-(-p // 1))) if seen <= k < seen + n})
        if ranks:
            wanted[r] = (seen, ranks)
        seen += n
    counts = d.where(F.col("_r").isin(list(wanted))).groupBy("_r", "_v").agg(F.count("*").alias("n"))
    counts = counts.withColumn("z", F.sum("n").over(W.partitionBy("_r").orderBy("_v")))
    hit = F.lit(False)
    for r, (before, ranks) in wanted.items():
        for k in ranks:
            hit = hit | ((F.col("_r") == r) & (F.col("z") > k - before) & (F.col("z") - F.col("n") <= k - before))
    spans = [(wanted[x["_r"]][0] + x["z"] - x["n"], wanted[x["_r"]][0] + x["z"], x["_v"]) for x in counts.where(hit).collect()]  # one row per rank
    d.unpersist()

    def value_at(k: int) -> float:
        return next(v for a, z, v in spans if a <= k < z)

    out = []
    for p in places:
        lo, hi = int(p // 1), int(-(-p // 1))
        a, b = value_at(lo), value_at(hi)
        out.append(a if lo == hi or a == b else (hi - p) * a + (p - lo) * b)
    return out

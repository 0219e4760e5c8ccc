"""Matrices as coordinate tables (i long, j long, v double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import draw, draw_number


def from_rows(df: DataFrame, row: str, array: str) -> DataFrame:
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(array).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def shape(m: DataFrame) -> DataFrame:
    return m.agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"))


def fill(spark: SparkSession, n: int, m: int, v: float | Column) -> DataFrame:
    cells = spark.range(n * m).select(F.expr(f"id div {m}").alias("i"), (F.col("id") % m).alias("j"))
    return cells.withColumn("v", (v if isinstance(v, Column) else F.lit(float(v))))


def rand(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """Numbers in [0, 1), from md5 draws of seed and cell."""
    return fill(spark, n, m, draw_number(draw(seed, "i", "j")).cast("double") / float(16**15))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return fill(spark, n, n, (F.col("i") == F.col("j")).cast("double"))


def like(m: DataFrame, v: float) -> DataFrame:
    """The shape of ``m`` with one value."""
    return m.select("i", "j", F.lit(float(v)).alias("v"))


def elementwise(m: DataFrame, f) -> DataFrame:
    return m.withColumn("v", f(F.col("v")))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "_w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("_w")).alias("v"))


SIDE = 4_096  # rows of one side that meet under one inner index, at most about
SALTS = 64


def dealt(x: DataFrame, y: DataFrame, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """``x`` (i, k, ...) and ``y`` (k, j, ...) with the columns _p and _q, so that joining on (k, _p, _q) meets every pair of one k once.

    The rows of each side under every k are counted. An index with many is cut: its
    rows of x into r parts by i, its rows of y into s parts by j; a row of x goes to
    all s parts of the other side and a row of y to all r, so that no key holds more
    than about ``side`` rows of a side. Other indices stay whole.
    """
    n = x.groupBy("k").agg(F.count("*").alias("n")).withColumn("m", F.lit(0).cast("long")).unionByName(y.groupBy("k").agg(F.count("*").alias("m")).withColumn("n", F.lit(0).cast("long")))
    parts = lambda c: F.ceil(F.sum(c) / side).cast("int")
    heavy = n.groupBy("k").agg(parts("n").alias("_r"), parts("m").alias("_s")).where("_r > 1 or _s > 1")
    # The plan of the cuts is joined by index and salt, as the index itself may hold most rows.
    heavy = heavy.withColumns({"_r": F.greatest("_r", F.lit(1)), "_s": F.greatest("_s", F.lit(1)), "_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})

    def planned(d: DataFrame, by: str) -> DataFrame:
        d = d.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(heavy, ["k", "_salt"], "left")
        return d.withColumns({"_r": F.coalesce("_r", F.lit(1)), "_s": F.coalesce("_s", F.lit(1))}).drop("_salt")

    part = lambda by, n: F.pmod(F.xxhash64(by, F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = planned(x, "i").withColumn("_p", part("i", "_r")).withColumn("_q", every("_s"))
    right = planned(y, "j").withColumn("_q", part("j", "_s")).withColumn("_p", every("_r"))
    return left.drop("_r", "_s"), right.drop("_r", "_s")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product: join on the inner index, cut where it is heavy; partial sums per output cell before the shuffle."""
    x, y = dealt(a.select("i", F.col("j").alias("k"), F.col("v").alias("_a")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b")))
    return x.join(y, ["k", "_p", "_q"]).groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def matmul_blocks(a: DataFrame, b: DataFrame, block: int = 256, side: int = 32) -> DataFrame:
    """Dense product: cells are gathered into blocks (places and values), block pairs are multiplied with numpy and the products summed. Inner blocks with more than ``side`` blocks are cut as those of :func:`matmul`."""
    import numpy as np
    import pyarrow as pa

    def blocks(m: DataFrame, r: str, c: str) -> DataFrame:
        place = (F.col("i") % block * block + F.col("j") % block).cast("int")
        g = m.groupBy(F.expr(f"i div {block}").alias(r), F.expr(f"j div {block}").alias(c)).agg(F.collect_list(F.struct(place.alias("p"), "v")).alias("s"))
        return g.select(r, c, F.col("s.p").alias(f"p{r}{c}"), F.col("s.v").alias(f"v{r}{c}"))

    def dense(p: pa.Array, v: pa.Array) -> np.ndarray:
        out = np.zeros(block * block)
        out[p.values.to_numpy()] = v.values.to_numpy(zero_copy_only=False)
        return out.reshape(block, block)

    def run(batches):
        for t in batches:
            for r in range(t.num_rows):
                c = dense(t.column("pik")[r], t.column("vik")[r]) @ dense(t.column("pkj")[r], t.column("vkj")[r])
                i, j = np.nonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(i + t.column("i")[r].as_py() * block), pa.array(j + t.column("j")[r].as_py() * block), pa.array(c[i, j])], ["i", "j", "v"])

    x, y = dealt(blocks(a, "i", "k"), blocks(b, "k", "j"), side)
    pairs = x.join(y, ["k", "_p", "_q"]).select("i", "j", "pik", "vik", "pkj", "vkj")
    return pairs.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def index(m: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Half-open ranges of rows and columns."""
    for c, r in (("i", rows), ("j", cols)):
        if r is not None:
            m = m.where((F.col(c) >= r[0]) & (F.col(c) < r[1]))
    return m


def assign_column(m: DataFrame, j: int, v: float) -> DataFrame:
    return m.withColumn("v", F.when(F.col("j") == j, F.lit(float(v))).otherwise(F.col("v")))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def reshape(m: DataFrame, n_cols: int, to_cols: int) -> DataFrame:
    """Row-major re-index."""
    p = F.col("i") * n_cols + F.col("j")
    return m.select(p.alias("p"), "v").select(F.expr(f"p div {to_cols}").alias("i"), (F.col("p") % to_cols).alias("j"), "v")


def concat_columns(a: DataFrame, b: DataFrame, a_cols: int) -> DataFrame:
    return a.unionByName(b.withColumn("j", F.col("j") + a_cols))


def total(m: DataFrame) -> DataFrame:
    return m.agg(F.sum("v").alias("total"))

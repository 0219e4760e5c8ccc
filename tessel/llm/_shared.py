"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"
#: While a step is written: its shuffle files go when it is done, and texts travel to Python in small batches.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_OWN: dict[str, str] = {}
#: Folders that materialize wrote and nobody has removed.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, where they are one process, may leave it unset; it
    gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can write")
        folder = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="tessel-"))
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike cached blocks the files outlive lost executors. The shuffle files of
    the job that wrote them are of no further use and are removed with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    WRITTEN.append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`materialize` returned, once nothing will read them again."""
    for t in tables:
        remove(t.sparkSession, [t._written])


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def tidy(run):
    """``run``, a function for mapInArrow, that gives Arrow's free memory back at the end of a partition.

    Spark keeps idle Python workers for a minute; what they hold counts beside the next step's heap.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return tidied


def words(text: Column | str) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int = 50_000) -> DataFrame:
    """Join ``left`` with ``right``, which has at most one row a key, on columns ``keys``; no key's rows meet in one task.

    Keys with more than ``rows`` rows on the left are dealt over parts of about
    ``rows``, and their row on the right is repeated once a part. Such keys are
    broadcast; ``rows`` grows with ``left``, so that there are 10,000 at most.
    Rows with a null in a key match nothing and are dealt over 1,000 parts.
    ``left`` should be a written table, as it is read three times.
    """
    rows = max(rows, left.count() // 10_000)
    whole = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    many = left.where(whole).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    hot = F.broadcast(many.select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.when(whole, 1).otherwise(1000))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), parts).cast("int"))
    each = right.where(whole).join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_parts").join(each.drop("_parts"), [*keys, "_part"], how).drop("_part")


def prefix_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one, in some fixed order of ``key``.

    No window spans the table: rows are dealt into 1,024 hash buckets, whose
    1,024 totals alone are summed in one task; inside a bucket a window runs.
    Rows with equal keys must be one row.
    """
    from pyspark.sql import Window as W

    d = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(1024)))
    totals = d.groupBy("_b").agg(F.sum(value).alias("_t"))
    before = totals.select("_b", (F.sum("_t").over(W.orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_b").orderBy(key)) - F.col(value)
    return d.withColumn("_in", inside).join(F.broadcast(before), "_b").withColumn(out, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")

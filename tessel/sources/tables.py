"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The column names of the published spam data set, in file order.
SPAM_COLUMNS = """
word_freq_make word_freq_address word_freq_all word_freq_3d word_freq_our word_freq_over
word_freq_remove word_freq_internet word_freq_order word_freq_mail word_freq_receive
word_freq_will word_freq_people word_freq_report word_freq_addresses word_freq_free
word_freq_business word_freq_email word_freq_you word_freq_credit word_freq_your
word_freq_font word_freq_000 word_freq_money word_freq_hp word_freq_hpl word_freq_george
word_freq_650 word_freq_lab word_freq_labs word_freq_telnet word_freq_857 word_freq_data
word_freq_415 word_freq_85 word_freq_technology word_freq_1999 word_freq_parts
word_freq_pm word_freq_direct word_freq_cs word_freq_meeting word_freq_original
word_freq_project word_freq_re word_freq_edu word_freq_table word_freq_conference
char_freq_; char_freq_( char_freq_[ char_freq_! char_freq_$ char_freq_#
capital_run_length_average capital_run_length_longest capital_run_length_total spam
""".split()


def spam_schema() -> T.StructType:
    """57 doubles and the label."""
    return T.StructType([*(T.StructField(n, T.DoubleType()) for n in SPAM_COLUMNS[:-1]), T.StructField(SPAM_COLUMNS[-1], T.IntegerType())])


def read_headerless_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=False)


def read_feature_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Headered CSV; all columns but the last are features (float), the last is the target."""
    df = spark.read.csv(path, schema=schema, header=True)
    return df.select(*[F.col(c).cast("float").alias(c) for c in df.columns[:-1]], F.col(df.columns[-1]).cast("float").alias(df.columns[-1]))


def write_feature_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", header).csv(path)


def write_model(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

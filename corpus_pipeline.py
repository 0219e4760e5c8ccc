"""Corpus pipeline: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents. SQL can't express the fitted
stages, so ``ORACLE_SQL`` is None; tests compare the stages with brute force.

Defined results, for every stage: verdicts are about rows, not ids, so rows
without a doc_id, with the same one, or repeated are judged each for themselves
(of equal rows the near-copy stage keeps one); null and empty texts fail the
quality rules, and where they reach a later stage have no hits, no links, no
repeats and one end id; an empty table gives an empty one; further columns are
kept, also those with names that the operators use.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm._shared import WRITTEN, materialize, remove, table
from tessel.llm.jaccard_join import jaccard_join
from tessel.llm.packing import pack
from tessel.llm.quality_rules import quality_rules
from tessel.llm.substring_dedup import substring_dedup
from tessel.llm.toxicity import fit, score


_BEFORE: list[str] = []  # intermediate tables of the stage before


def _stage(f):
    """A stage that first removes the intermediate tables of the stage before: its result has been written by now. Those that ``docs`` itself still reads stay."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        remove(spark, [p for p in _BEFORE if not any(p.rsplit("/", 1)[-1] in x for x in files)])
        held = set(WRITTEN)
        out = f(spark, docs, sf_dir)
        _BEFORE[:] = [p for p in WRITTEN if p not in held]
        return out

    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a key for each row, and the key's name."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows"), key


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names renamed, as an operator replaces them, and each column's name there."""
    now = {c: f"_aside_{c}" if c in names else c for c in docs.columns}
    return docs.withColumnsRenamed(now), now


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and every certified cut-off let through."""
    rows, key = _keyed(docs)
    bad = quality_rules(rows, table(spark, sf_dir, "labels"), keep=(key,)).where(~F.col("kept")).select(key)
    return rows.join(bad, key, "left_anti").select(docs.columns)


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows, now = _aside(docs, "score")
    return score(rows, model).where("score < 0.5").select(*[F.col(now[c]).alias(c) for c in docs.columns])


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8: the smallest id, a missing one last, rows of one id by a hash of their texts."""
    rows, key = _keyed(docs)
    groups = jaccard_join(rows.select(F.col(key).alias("doc_id"), "text"), n=5, percent=80)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), F.col(key).alias("row")).alias("at")
    members = groups.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, order), key)
    first = members.groupBy("component_id").agg(F.min("at").alias("at")).select(F.col("at.row").alias(key))
    return rows.join(first, key, "left_semi").select(docs.columns)


@_stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that stand earlier in the corpus."""
    rows, now = _aside(docs, "n_words", "n_removed", "kept_text")
    d = substring_dedup(rows, window=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return d.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col(now[c])).alias(c) for c in docs.columns])


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)


STAGES = [
    ("quality_rules", keep_good),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Mixing sources to target weights: hash order, distributed prefix sums, exact budgets.

1. A document's size is its number of words. Sources, in the order of their code
   points and null last, take the weights in turn, again from the first when they
   run out.
2. The sizes of all documents together are shared out by weight. A source's target
   stops at ``most`` times its size; what is over goes to the sources below their
   limit, by weight, until none is above. Every round is one aggregate of the
   sources, of which one row reaches the driver.
3. A document's key is the md5 of seed and id: a random order that reruns keep. The
   leading digits of the key cut each source into even ranges, as many as the
   table asks for, so a source with most of the documents is as evenly dealt as
   any other. The ranges' totals give each range the sum before it, a window
   inside a range gives each document's.
4. A source's budget is its target, rounded to whole words. Documents are taken
   whole as many times as all of them fit in; the rest of the budget is taken in
   the order of the keys, and cut inside the document in which it ends.

All of it is DataFrame functions. ``mix`` returns the rows with their share,
``emit`` the mixed texts.

Defined results: null and empty texts have size 0, are taken 0 words of and count
in no target; a source without words has target 0; null is a source of its own;
repeated rows and rows that share an id are documents of their own (rows with one
id and size are interchangeable, so which of them comes first changes nothing);
rows with a null id are mixed like others; an empty table gives no rows; extra
columns pass through ``mix`` unless they carry a name that it adds, which then
holds the added value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranking import ordered_rank
from ._shared import materialize, table, words

WEIGHTS = (1, 2, 3)
MOST = 3  # times that a source may be used
RANGE = 50_000  # documents of a range, at most about
ADDED = ("size", "source_size", "target", "whole", "part", "taken")


def order_key(seed: int, id_: str) -> Column:
    """md5 (hexadecimal) of seed and id; rows without an id share one."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_).cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to sources (source, size, ...): shares of all sizes by weight, none above ``most`` times its size."""
    ranked = ordered_rank(sizes, "source", "_rank").withColumn("_w", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights)).cast("int")).cast("long"))
    ranked = materialize(ranked.withColumn("_limit", F.col("size") * most), "mix-sources")
    free, capped, level, n = F.lit(True), -1, None, 0
    total = ranked.agg(F.sum("size")).first()[0] or 0
    while True:
        # The share of a weight, if the sources at their limit are those found so far; more rounds can only add some.
        r = ranked.agg(F.coalesce(F.sum(F.when(free, F.col("_w"))), F.lit(0)), F.coalesce(F.sum(F.when(~free, F.col("_limit"))), F.lit(0)), F.count_if(~free)).first()
        if r[0] == 0 or r[2] == capped:
            break
        level, capped = (total - r[1]) / r[0], r[2]
        free = F.col("_limit") > F.col("_w") * F.lit(level)
    share = F.col("_w") * F.lit(level) if level is not None else F.lit(0.0)
    return ranked.withColumn("target", F.when(free, share).otherwise(F.col("_limit").cast("double"))).drop("_rank", "_w", "_limit")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, text: str = "text", source: str = "source", id_: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, whole (times it is taken in full), part (words of a last, cut pass) and taken (words in all).

    ``keep`` names the columns that pass through (all by default): what it leaves out is read once, for sizes and keys.
    """
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    own = {"_size": F.size(words(text)).cast("long"), "_key": order_key(seed, id_), "_id": F.col(id_), "_tie": F.xxhash64(text), "_none": F.col(source).isNull(), "_src": F.coalesce(F.col(source).cast("string"), F.lit(""))}
    d = materialize(docs.select(F.struct(*rest).alias("_row") if rest else F.lit(0).alias("_row"), *[c.alias(k) for k, c in own.items()]), "mix-documents")
    n, digits = d.count(), 0
    while n > RANGE * 16**digits:
        digits += 1
    at = ["_none", "_src", "_range"]
    d = d.withColumn("_range", F.substring("_key", 1, digits) if digits else F.lit(""))
    ranges = materialize(d.groupBy(*at).agg(F.sum("_size").alias("_words")), "mix-ranges")
    sizes = ranges.groupBy("_none", "_src").agg(F.sum("_words").alias("size")).withColumn("source", F.when(~F.col("_none"), F.col("_src")))
    goals = targets(sizes, weights, most).select("_none", "_src", F.col("size").alias("source_size"), "target")
    before = F.sum("_words").over(W.partitionBy("_none", "_src").orderBy("_range")) - F.col("_words")
    ranges = ranges.withColumn("_before", before).join(goals, ["_none", "_src"]).drop("_words")
    inside = F.sum("_size").over(W.partitionBy(*at).orderBy("_key", "_id", "_size", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size")
    d = d.withColumn("_in", inside).join(ranges, at)
    budget, all_, none = F.round("target").cast("long"), F.nullif(F.col("source_size"), F.lit(0)), F.lit(0).cast("long")
    left = F.coalesce(budget % all_, none) - F.col("_before") - F.col("_in")  # of the last pass, from this document on
    d = d.select("*", F.col("_size").alias("size"), F.coalesce(F.floor(budget / all_), none).alias("whole"), F.least(F.col("_size"), F.greatest(none, left)).alias("part"))
    return d.withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).select(*[F.col("_row")[c].alias(c) for c in rest], *ADDED)


def emit(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus: one row per use of a document with ``epoch`` (from 1); a cut use holds its first ``part`` words, joined by spaces."""
    uses = F.col("whole") + (F.col("part") > 0).cast("long")
    d = mixed.where(uses > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), uses)))
    cut = (F.col("epoch") > F.col("whole")) & (F.col("part") < F.col("size"))
    return d.withColumn(text, F.when(cut, F.array_join(F.slice(words(text), 1, F.col("part").cast("int")), " ")).otherwise(F.col(text)))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "whole", "part")


__all__ = ["emit", "mix", "op12_mixing", "targets"]

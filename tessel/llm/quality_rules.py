"""Quality rules with risk-controlled cut-offs.

Fixed base rules reject texts that no cut-off may save. On top, each statistic
of :data:`RULES` gets a cut-off per stratum. One half of the labelled holdout
rows (by the checksum of their ids) selects them: the strictest of a statistic
that an exact binomial test lets pass, in the order of the bad documents they
catch. The other half proves them: in that order, cut-offs are used as long as
the exact test shows that those so far together reject at most ``risk`` of the
good documents of the stratum. Such a sequence of tests, left at its first
failure, needs no correction; the error level ``delta`` is shared over the
strata (Bonferroni). So with probability ``1 - delta`` the rules of every stratum
together keep the promise. Only DataFrame functions run: no Python touches a row.

Risk and proof are about the good documents that pass the base rules. Defined
results: a null or empty text has no words and fails the base rules;
null or unknown strata form a stratum of their own; without labels (or with too
few to prove anything) nothing but the base rules rejects; a document labelled
twice counts once, as good if any label says so; repeated documents are judged
each for themselves; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import GAP, materialize, table, words

SYMBOLS = "#*$%&|<>"
#: statistic, whether large values are bad, candidate cut-offs (fixed before any label is seen).
RULES = (
    ("symbol_share", True, (0.01, 0.02, 0.04, 0.08, 0.15)),
    ("dup_line_share", True, (0.2, 0.4, 0.6)),
    ("repeat_share", True, (0.1, 0.2, 0.3, 0.4)),
    ("mean_word", True, (8.0, 10.0, 15.0)),
    ("mean_word", False, (2.0, 3.0)),
    ("mark_share", True, (0.02, 0.05, 0.1)),
    ("upper_share", True, (0.1, 0.2, 0.4)),
)
_POS = 31  # low bits of a key: the position; high bits: the hash of the trigram


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of each whole text; ``text`` itself is kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words(t)).withColumn("n_words", F.size("_w").cast("long"))
    # Trigram keys sort as plain longs: hash above, position below. Equal hashes stand side by side.
    key = lambda i: F.shiftleft(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)), _POS).bitwiseOR(i.cast("long"))
    none = F.array().cast("array<long>")
    d = d.withColumn("_k", F.when(F.col("n_words") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), key))).otherwise(none))
    same = lambda a, b: F.coalesce(F.shiftright(a, _POS) == F.shiftright(b, _POS), F.lit(False))
    at = lambda i: F.try_element_at("_k", i)  # noqa: E731  1-based, null outside
    twin = F.filter("_k", lambda x, i: same(x, F.when(i > 0, at(i))) | same(x, at(i + 2)))
    pos = lambda x: x.bitwiseAND(F.lit((1 << _POS) - 1)).cast("int")
    # The few positions whose hashes meet are compared again as text, so a collision counts nothing.
    gram = lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    d = d.withColumn("_c", twin)
    d = d.withColumn("_g", F.array_sort(F.transform("_c", lambda x: F.struct(gram(pos(x)).alias("g"), pos(x).alias("p")))))
    g_at = lambda i: F.try_element_at("_g", i)["g"]
    real = F.filter("_g", lambda x, i: F.coalesce(x["g"] == F.when(i > 0, g_at(i)), F.lit(False)) | F.coalesce(x["g"] == g_at(i + 2), F.lit(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(real, lambda x: x["p"])))
    # A window at p covers p, p+1, p+2; what the next one covers again counts once.
    covered = F.when(F.size("_p") == 0, F.lit(0)).otherwise(
        F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.try_element_at("_p", i + 2) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    )
    d = d.withColumn("n_repeat_words", F.when(F.size("_c") == 0, F.lit(0)).otherwise(covered).cast("long"))
    bare = F.regexp_replace(t, GAP, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, GAP, "") != "")
    less = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    d = d.withColumn("word_chars", F.length(bare).cast("long")).withColumn("n_symbols", less(SYMBOLS)).withColumn("_marks", less("!?"))
    d = d.withColumn("_l", lines)
    d = d.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("_upper", F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    d = d.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word": share("word_chars", "n_words"), "mark_share": share("_marks", "word_chars"), "upper_share": share("_upper", "word_chars"),
    })
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.drop("_w", "_k", "_c", "_g", "_p", "_l", "_marks", "_upper")


def _ln_factorial(x: Column) -> Column:
    """ln(x!): Stirling's series from 16 on (error below 1e-12), a sum of logs before."""
    x = x.cast("double")
    big = (x + 0.5) * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586)) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(x.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(x >= 16, big).when(x >= 1, small).otherwise(F.lit(0.0))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k below the mean n * p; 1 above it, where no test passes.

    The terms fall from k downwards, each by a factor below one; 4,000 of them
    are summed and the rest bounded by the geometric series, so the value is
    never too small: the test stays valid for any n.
    """
    first = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    steps = F.when(k >= 1, F.sequence(F.lit(0), F.least(k, F.lit(4000)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.aggregate(steps, start, step)
    ratio = F.greatest(k - 4000, F.lit(0)) / (n - k + 1) * ((1 - p) / p)
    tail = total["t"] * ratio / F.greatest(1 - ratio, F.lit(1e-9))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(first) * (total["s"] + tail)))


def proves(doc_id: Column) -> Column:
    """Whether a labelled row is of the proving half."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 2 == 1


def calibrate(stats: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Cut-offs (stratum, rule, stat, above, cut, n_good, n_rejected, p_value) that the holdout proves safe.

    ``labels`` has doc_id and quality. A cut-off is selected only if it catches
    bad documents at a higher rate than good ones. ``n_rejected`` of ``n_good``
    proving rows are rejected by this cut-off and those before it. Everything
    is counted in two passes over the labelled rows and one row per stratum and
    cut-off.
    """
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_q"))
    cells = [(i, j, s, above, float(c)) for i, (s, above, cuts) in enumerate(RULES) for j, c in enumerate(cuts)]
    base = stats.where(~F.col("base_failed")).select("doc_id", F.col(stratum).alias("stratum"), *sorted({r[0] for r in RULES})).join(lab, "doc_id").withColumn("_proves", proves(F.col("doc_id")))
    hit = lambda s, above, c: (F.col(s) > c) if above else (F.col(s) < c)
    good, bad = ~F.col("_proves") & (F.col("_q") == 1), ~F.col("_proves") & (F.col("_q") == 0)
    counts = base.groupBy("stratum").agg(
        F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad"), F.count_if(F.col("_proves") & (F.col("_q") == 1)).alias("n_proving"),
        *[F.count_if(hit(s, a, c) & good).alias(f"g{i}_{j}") for i, j, s, a, c in cells],
        *[F.count_if(hit(s, a, c) & bad).alias(f"b{i}_{j}") for i, j, s, a, c in cells],
    )
    row = lambda i, j, s, a, c: F.struct(F.lit(i).alias("rule"), F.lit(s).alias("stat"), F.lit(a).alias("above"), F.lit(c).alias("cut"), F.col(f"g{i}_{j}").alias("g"), F.col(f"b{i}_{j}").alias("b"))
    long = counts.select("stratum", "n_good", "n_bad", "n_proving", F.count("*").over(_all()).alias("_strata"), F.inline(F.array(*[row(*c) for c in cells])))
    useful = F.col("b") * F.col("n_good") > F.col("g") * F.col("n_bad")
    safe = long.where((F.col("n_good") > 0) & useful & (binomial_cdf(F.col("g"), F.col("n_good"), risk) <= delta))
    strict = F.when(F.col("above"), -F.col("cut")).otherwise(F.col("cut"))
    one = safe.groupBy("stratum", "rule", "stat", "above", "_strata", F.col("n_proving").alias("n_good")).agg(F.max_by("cut", strict).alias("cut"), F.max_by("b", strict).alias("b"))
    one = one.withColumn("_place", F.row_number().over(W.partitionBy("stratum").orderBy(F.desc("b"), "rule")))  # as many rows as rules
    # The first of the selected cut-offs that rejects each good document.
    per = one.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("cut", "_place")))).alias("_cuts"))
    which = lambda i: F.try_element_at("_cuts", F.lit(i))
    first = F.least(*[F.when((F.col(s) > which(i)["cut"]) if above else (F.col(s) < which(i)["cut"]), which(i)["_place"]) for i, (s, above, _) in enumerate(RULES)])
    hits = base.where("_proves and _q = 1").join(F.broadcast(per), "stratum").withColumn("_place", first).where("_place is not null").groupBy("stratum", "_place").agg(F.count("*").alias("_hits"))
    so_far = F.sum(F.coalesce("_hits", F.lit(0))).over(W.partitionBy("stratum").orderBy("_place"))
    tested = one.join(hits, ["stratum", "_place"], "left").withColumn("n_rejected", so_far).withColumn("p_value", binomial_cdf(F.col("n_rejected"), F.col("n_good"), risk))
    # The counts only grow along the sequence, so what passes comes before what fails.
    return tested.where((F.col("n_good") > 0) & (F.col("p_value") * F.col("_strata") <= delta)).select("stratum", "rule", "stat", "above", "cut", "n_good", "n_rejected", "p_value")


def _all():
    return W.partitionBy(F.lit(1))  # one row per stratum


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Add ``kept``: not base_failed and within every cut-off of the row's stratum.

    The cut-offs travel as one small row per stratum (a map of at most
    ``len(RULES)`` numbers), joined by the stratum.
    """
    per = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("_cuts")).withColumnRenamed("stratum", "_s")
    d = stats.join(F.broadcast(per), F.col(stratum).eqNullSafe(F.col("_s")), "left")
    bad = F.lit(False)
    for i, (s, above, _) in enumerate(RULES):
        cut = F.try_element_at("_cuts", F.lit(i))
        bad = bad | F.coalesce((F.col(s) > cut) if above else (F.col(s) < cut), F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_s", "_cuts")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics and verdict (``base_failed``, ``kept``) of every document, by language (a missing one is its own stratum); columns as of :func:`text_stats`, without the text, and those of ``keep``."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    stats = text_stats(docs.select("doc_id", F.col("text").alias("text"), lang.alias("lang"), *keep))
    stats = materialize(stats.withColumn("stratum", F.coalesce("lang", F.lit("?"))).drop("text", "lang"), "quality-stats")
    holdout = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return judge(stats, calibrate(stats, holdout, "stratum", risk, delta), "stratum")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")

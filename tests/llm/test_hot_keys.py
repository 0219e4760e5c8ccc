"""Keys that hold half of all rows: whole results, rows in several tasks."""

from pyspark.sql import functions as F

from tessel.llm._graph import components
from tessel.llm._shared import hot_join
from tessel.llm._words import labelled_texts
from tessel.llm.jaccard_join import jaccard_join
from tessel.llm.nearest import entries
from tessel.llm.token_files import read_token_files, write_token_files


def test_hot_join_deals_hot_keys(spark):
    left = spark.range(12_000).select("id", F.when(F.col("id") < 6_000, 1).when(F.col("id") < 8_000, None).otherwise(F.col("id") % 50 + 2).cast("long").alias("k"))
    right = spark.range(1, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        want = sorted((r["k"] or 0, r["id"], r["v"] or 0) for r in left.join(right, "k", how).collect())
        got = sorted((r["k"] or 0, r["id"], r["v"] or 0) for r in hot_join(left, right, ["k"], how, rows=100).collect())
        assert got == want
    both = left.withColumn("j", F.col("id") % 2), right.withColumn("j", F.col("k") % 2)
    assert hot_join(*both, ["k", "j"], rows=100).count() == both[0].join(both[1], ["k", "j"]).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in hot_join(left, right.repartition(4), ["k"], "left", rows=100).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 12_000 and max(sizes) < 2 * 12_000 / 4


def test_hubs_keep_their_links(spark):
    """A star, one whose hub is the largest node, and a chain of both."""
    links = [(0, i) for i in range(1, 3000)] + [(10_000, i) for i in range(4000, 7000)] + [(20_000 + i, 20_001 + i) for i in range(30)] + [(2999, 20_000)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert got == {**{n: 0 for n in [*range(3000), *range(20_000, 20_031)]}, **{n: 4000 for n in [10_000, *range(4000, 7000)]}}


def test_half_of_all_rows_are_copies(spark):
    rows = [(i, "one text that stands in half of all rows") for i in range(3000)] + [(3000 + i, f"text number {i} of its own kind here") for i in range(2500)] + [(6000 + i, t) for i, t in enumerate(["", None, " "] * 170)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows) and all(got[i] == (6, 0) for i in range(3000)) and all(got[i][1] == i for i in range(3000, 5500)) and all(got[i] == (0, i) for i in range(6000, 6510))


def test_cells_of_a_pair_follow_its_classes_not_the_blocks(spark, monkeypatch):
    """Pairs and groups of near copies: a pair's columns meet in one product, a group's in a few, at 2 as at 16 partitions."""
    from tessel.llm import jaccard_join as joins

    made, rows = joins._product, []
    for i in range(60):
        words = [f"p{i}_{j}" for j in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + ["other"]))]
    for i in range(5):
        words = [f"g{i}_{j}" for j in range(300)]
        rows += [(1000 + 20 * i + x, " ".join(words[: 10 * x] + [f"own{x}"] + words[10 * x + 1 :])) for x in range(20)]
    sets = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(joins._emit(4, "sets"), "cls long, n long, g array<long>")
    counts, shared = [], []
    for n in ("2", "16"):
        cells = spark.sparkContext.accumulator(0)

        def counting(percent, cells=cells):
            def run(batches):
                for b in made(percent)(batches):
                    cells.add(len(b) - b.column("b").null_count)
                    yield b

            return run

        monkeypatch.setattr(joins, "_product", counting)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            shared.append(sorted(map(tuple, joins.block_products(sets, 85)[0].collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        counts.append(cells.value)
    of = {r["cls"]: set(r["g"]) for r in sets.collect()}
    want = [(a, b, len(of[a]), len(of[b]), both) for a in sorted(of) for b in sorted(of) if a < b and (both := len(of[a] & of[b]))]
    assert shared == [want, want] and len(want) == 60 + 5 * 190
    assert max(counts) <= 60 + 5 * (190 + 171)  # columns without the group's smallest class are a second block


def test_fits_are_bounded_where_documents_share_an_id(spark):
    docs = spark.range(4_000).select((F.col("id") % 8).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    labels = spark.range(8).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = labelled_texts(docs, labels, "toxic", 5).collect()
    assert 0 < len(rows) <= 5 and len({r["doc_id"] for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, labelled_texts(docs.repartition(7), labels, "toxic", 5).collect()))
    assert labelled_texts(docs.limit(0), labels, "toxic", 5).count() == 0


def test_token_files_of_rows_without_an_id(spark, tmp_path):
    """Half of all rows lack an id: several parts hold them, all are read back, starts have no gaps."""
    import public_tokenizers

    docs = spark.range(600).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    rows = sorted(read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert len(rows) == 600 and [r["doc_id"] for r in rows[300:]] == list(range(0, 600, 2))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    parts = spark.read.parquet(str(tmp_path / "t")).groupBy("part").count().count()
    assert parts == 4


def test_repeated_vectors_are_one_entry(spark):
    rows = [(7, [1.0, 2.0])] * 3000 + [(i, [1.0, 2.0]) for i in range(8, 40)] + [(100 + i, [float(i), 0.5]) for i in range(50)]
    got = {r["eid"]: list(r["ids"]) for r in entries(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), 2, 10).collect()}
    assert len(got) == 51 and got[7] == list(range(7, 18))


def test_what_meets_long_columns_follows_them_not_the_partitions(spark, monkeypatch):
    """A row joined to a long column goes out once a part of its members, not once a partition, as Spark may broadcast it; results stay where columns have several parts."""
    from tessel.llm import jaccard_join as joins

    from . import brute

    rows, sent = [], []
    for g in range(3):
        words = [f"w{g}_{j}" for j in range(120)]
        rows += [(100 * g + x, " ".join([*words[:x], f"own{g}_{x}", *words[x + 1 :]])) for x in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame, join = type(docs), type(docs).join

    def counting(self, other, on=None, how=None):
        if isinstance(on, list) and on == ["gram", "salt"]:
            sent.append(other.count())
        return join(self, other, on, how)

    monkeypatch.setattr(frame, "join", counting)
    monkeypatch.setattr(joins, "PART_ROWS", 24, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joins.jaccard_join(docs, 5, 80).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute.components(dict(rows), 5, 80)
    columns = len(set.union(*(brute.shingles(t, 5) for _, t in rows)))
    long = 3 * 116  # those of a group's common text
    assert columns > long < max(sent) <= 3 * long

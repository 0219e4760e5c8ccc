"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names: each has a defined result."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import html_extraction, jaccard_join, nearest, packing, quality_classifier, quality_rules, sentencepiece_fst, substring_dedup, token_files, toxicity
from tessel.llm._shared import shared_dir

from . import brute

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
COPY = " ".join(f"c{i}" for i in range(80))
ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (5, "One TWO three"), (6, LONG), (7, COPY), (7, COPY), (8, COPY + " tail"), (9, "x " + COPY), (None, COPY), (None, None), (10, "日本 語 " * 40)]
EXTRA = "n score doc gram cls row text_ label node start"  # names the operators use inside


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in EXTRA.split():
        d = d.withColumn(c, F.lit("clash"))
    return d.withColumns({"lang": F.lit(None).cast("string"), "n_words": F.lit("clash"), "repeats": F.lit(1)}).persist()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2, "clash") for i in range(1, 11)] + [(4, 1, 1, "twice"), (None, 1, 0, "null"), (5, None, None, "null")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


TOK = public_tokenizers.path("byte_bpe_50k.json")


def test_packing(spark, docs):
    rows = packing.pack(docs, TOK, 1).collect()
    total = sum(r["length"] for r in rows)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOK)
    assert total == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert all(r["ids_crc32"] is not None for r in rows)
    assert packing.pack(docs.limit(0), TOK, 1).count() == 0


def test_token_files(spark, docs):
    import uuid

    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, TOK, 2)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    token_files.write_token_files(docs.limit(0), path + "e", TOK, 2)
    assert token_files.read_token_files(spark, path + "e").count() == 0


def test_jaccard(spark, docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect()}
    want = brute.components({k: t for k, t in ROWS if k is not None})
    assert {g for g in got if g[0] is not None} == {(k, *v) for k, v in want.items()}
    assert {g for g in got if g[0] is None} == {(None, 0, None), (None, 77, 7)}
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_jaccard_many_copies(spark):
    """A large group of near copies, and many texts that share one passage only."""
    rng = np.random.default_rng(0)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(150):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"new{i}"
        rows.append((i, " ".join(w)))
    for i in range(150, 260):
        rows.append((i, " ".join([f"p{j}" for j in range(40)] + [f"u{i}_{j}" for j in range(int(rng.integers(8, 60)))])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(dict(rows))


def test_dedup(spark, docs):
    rows = substring_dedup.substring_dedup(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["n_words"], r["n_removed"]))
    assert by[7] == {(80, 0)} and by[8] == {(81, 80)} and by[9] == {(81, 80)} and by[None] == {(80, 80), (0, 0)} and by[6] == {(60_000, 0)} and by[1] == {(0, 0)}
    assert by[10] == {(80, 78)}  # a text that repeats itself keeps its first two words
    assert {r["n"] for r in rows} == {"clash"}
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    pool = [" ".join(f"k{int(x)}" for x in rng.integers(0, 3000, 45)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            parts.append(pool[int(rng.integers(0, 6))][int(rng.integers(0, 60)) :] if rng.random() < 0.5 else " ".join(f"k{int(x)}" for x in rng.integers(0, 3000, 25)))
        rows.append((i, " ".join(parts)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.without_repeats(dict(rows))


def test_rules(spark, docs, labels):
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        texts = [brute.stats(t) for k, t in ROWS if k == r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) in texts
        assert r["kept"] == (not r["base_failed"])  # ten labels prove nothing
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("mod,label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_scores(spark, docs, labels, mod, label):
    for lab in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        rows = mod.score(docs, mod.fit(docs, lab)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert mod.score(docs.limit(0), mod.fit(docs.limit(0), labels)).count() == 0


def test_sentencepiece(spark, docs):
    rows = sentencepiece_fst.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(ROWS) and all(r["round_trip"] for r in rows)
    assert sentencepiece_fst.encode(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_html(spark):
    page = "<html><body><nav>m</nav><article><p>text</p></article></body></html>"
    rows = [(1, None, None), (2, "nonsense", ""), (3, "http://a.b/x", page), (3, "http://a.b/x", page), (4, None, page), (5, "http://a.b/y", "<p>only"), (None, "http://a.b/z", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "text": F.lit("clash"), "wrapper": F.lit(1)})
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extraction.extract(df).collect())
    assert got == sorted([("1", "", 0), ("2", "", 0), ("3", "text", 4), ("3", "text", 4), ("4", "text", 4), ("5", "only", 4), ("None", "text", 4)])
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_html_templates(spark):
    """A host with several templates, and pages without a host: none is emptied by the largest."""
    page = lambda body: f"<html><body><nav>menu</nav>{body}<footer>foot</footer></body></html>"
    forms = [
        ("<article><p>{}</p></article>", "long text of the largest template"), ("<div class='wrap'><article><p>{}</p></article></div>", "inner"),
        ("<article class='post'><p>{}</p></article>", "post"), ("<article class='post featured'><p>{}</p></article>", "featured"),
        ("<table><tr><td>{}</td></tr></table>", "cell"), ("<div class='box'><p>{}</p></div>", "box"),
    ]
    rows, want, i = [], [], 0
    for url in ("http://a.b/x", None, "/relative", "nonsense"):
        for n, (form, text) in enumerate(forms):
            for _ in range(5 if n == 0 else 1):
                i += 1
                rows.append((i, url, page(form.format(text))))
                want.append((i, text, len(text)))
    for n, (form, text) in enumerate([forms[5]] * 5 + [forms[4]]):  # no article-like element on the whole host
        rows.append((100 + n, "http://c.d/x", page(form.format(text))))
        want.append((100 + n, text, len(text)))
    rows.append((200, "http://a.b/x", page("<article></article>")))
    want.append((200, "", 0))
    # Classes only; reader comments inside the article; a menu without a name inside it.
    inner = "<div class='story'><p>{0}</p></div>", "<article><p>{0}</p><div class='comments'><p>reader {0}</p></div></article>", "<article><div><ul><li><a href=x>Home</a><li><a href=y>Shop</a></ul></div><p>{0}</p><p>By the editors</p></article>"
    for n, form in enumerate(inner):
        for k in range(4):
            rows.append((300 + 10 * n + k, f"http://d{n}.e/{k}", page(form.format(f"story {k} told"))))
            text = f"story {k} told" + ("\nBy the editors" if n == 2 else "")
            want.append((300 + 10 * n + k, text, len(text)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extraction.extract(df).collect()) == want


def test_nearest(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0, None]), (104, [1.0, 2.0, 3.0]), (105, []), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>").withColumn("eid", F.lit("clash"))
    got = [(r["rank"], r["vec_id"], r["score"]) for r in nearest.search(v, v.where("id = 0"), k=12).orderBy("rank").collect()]
    want = sorted((0.0 if i % 3 == 0 else float(i % 3), i) for i in range(1, 30))[:12]
    assert got == [(n + 1, i, s) for n, (s, i) in enumerate(want)]
    assert nearest.search(v.limit(0), v).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in nearest.search(few, few).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def unit(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_scans_a_part_of_the_lists(spark):
    """10,000 independent directions in doubles, 0.6 of the lists: recall@10; queries that share an id; the exact setting."""
    x = unit(10_000, 3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(8).persist()
    want = {}
    for q in range(0, 10_000, 250):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want[q] = (set(np.argsort(d)[:10].tolist()), d)
    got = {}
    for r in nearest.search(v, v.where("id % 250 = 0")).collect():
        assert abs(r["score"] - want[r["query_id"]][1][r["vec_id"]]) < 1e-14
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & want[q][0]) for q in want) >= 0.9 * 10 * len(want)
    exact = {}
    for r in nearest.search(v.where("id < 2000"), v.where("id in (0, 250)"), rerank=None).collect():
        exact.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in exact:
        d = ((x[:2000] - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert exact[q] == set(np.argsort(d)[:10].tolist())


def test_nearest_values(spark):
    """Doubles that float32 can't hold, very large values, many copies of one vector, two vectors with one query id."""
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(12)] + [(100 + i, [5.0, 5.0]) for i in range(5000)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = [(r["vec_id"], r["score"]) for r in nearest.search(v, v.where("id = 0"), k=3).orderBy("rank").collect()]
    assert got == [(i, abs(rows[i][1][0] - 1.0)) for i in (1, 2, 3)]
    assert [r["vec_id"] for r in nearest.search(v, v.where("id = 103"), k=4).orderBy("rank").collect()] == [100, 101, 102, 104]
    big = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1e300]), (3, [-1e300, 1e299])], "id long, v array<double>")
    got = [(r["vec_id"], r["score"]) for r in nearest.search(big, big.where("id = 1")).orderBy("rank").collect()]
    assert [g[0] for g in got] == [2, 3] and np.allclose([g[1] for g in got], [2**0.5 * 1e300, np.hypot(2, 0.1) * 1e300])
    twice = spark.createDataFrame([(1, [9.0, 9.0]), (1, [0.1, 0.0]), (2, [0.0, 0.2]), (3, [8.0, 9.0])], "id long, v array<double>")
    assert [r["vec_id"] for r in nearest.search(twice, twice.where("id = 1")).orderBy("rank").collect()] == [2, 3]


def test_pipeline_stages(spark, data):
    """Each stage against what it is made of, on its own input."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    near = stage["ngram_jaccard_join"](spark, docs, data)
    assert near.columns == docs.columns
    want = {k for k, (_, c) in brute.components(texts, 5, 80).items() if k == c}
    assert {r["doc_id"] for r in near.collect()} == want
    good = stage["quality_rules"](spark, docs, data)
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and all(not brute.stats(texts[k])[5] for k in kept)
    out = stage["substring_dedup"](spark, docs, data)
    assert out.columns == docs.columns
    wanted = brute.without_repeats(texts)
    for r in out.collect():
        n, gone, sha = wanted[r["doc_id"]]
        assert (hashlib.sha256(r["text"].encode()).hexdigest() == sha) if gone else r["text"] == texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"] or "")


def test_pipeline_judges_rows(spark, docs, data):
    """Rows without an id, with one id for several texts, and repeated rows, through every stage."""
    stage = dict(corpus_pipeline.STAGES)
    near = COPY.replace("c", "d")
    more = [(20, " ".join(f"good{i}" for i in range(60))), (20, "too short"), (None, near), (None, near + " tail"), (21, near.replace("d", "e")), (21, "another text of one id")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    both = docs.unionByName(extra.withColumns({c: F.lit(1) if c == "repeats" else F.lit(None).cast("string") if c == "lang" else F.lit("clash") for c in docs.columns[2:]}))
    rows, order = ROWS + more, lambda xs: sorted(xs, key=repr)

    def out(name):
        d = stage[name](spark, both, data)
        assert d.columns == both.columns
        got = d.collect()
        assert all(r[c] == "clash" for r in got for c in [*EXTRA.split(), "n_words"])
        return order([(r["doc_id"], r["text"]) for r in got])

    assert out("quality_rules") == order([r for r in rows if not brute.stats(r[1])[5]])
    gone = [(5, ROWS[4][1]), (7, COPY), (8, COPY + " tail"), (9, "x " + COPY), (None, COPY)]
    want = list(rows)
    for r in gone:
        want.remove(r)
    kept = out("ngram_jaccard_join")
    assert len([r for r in kept if r in more[2:4]]) == 1 and [r for r in kept if r not in more[2:4]] == order([r for r in want if r not in more[2:4]])
    toxic = out("toxicity")
    assert all(toxic.count(r) in (0, rows.count(r)) for r in rows)
    assert len(out("substring_dedup")) == len(rows)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOK)
    assert sum(r["length"] for r in stage["packing"](spark, both, data).collect()) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_pipeline_runs(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.count() > 0 and "sequence_id" in rows.columns

"""The operators' inner parts."""

import functools
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.llm import html_extraction, packing, quality_classifier, quality_rules, sentencepiece_fst, token_files, toxicity
from tessel.llm._graph import components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50_000), max_size=700))
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    offsets, blocks = token_files.pack_ids(x)
    assert (token_files.unpack_ids(blocks, offsets, len(x)) == x).all()
    names, lens, back = token_files.read_shard(token_files.write_shard(pa.array([7, None], pa.int64()), np.array([len(x), min(3, len(x))]), np.concatenate([x, x[:3]])))
    assert names.to_pylist() == [7, None] and lens.tolist() == [len(x), min(3, len(x))] and (back == np.concatenate([x, x[:3]])).all()


@pytest.mark.parametrize("width", range(33))
def test_blocks_take_the_percentile_width(width):
    """Nine tenths of a block's differences fit the width, the rest are exceptions; every width packs to as many bits."""
    rng = np.random.default_rng(width)
    x = rng.integers(0, 1 << width, 256, dtype=np.uint64).astype(np.uint32) if width else np.full(256, 5, np.uint32)
    x[0], x[1] = 0 if width else 5, (1 << width) - 1 if width else 5
    need = sorted(int(v - x.min()).bit_length() for v in x.tolist())
    offsets, image = token_files.pack_ids(x)
    assert image[4] == need[230] and len(image) == 7 + 32 * need[230] + 6 * sum(n > need[230] for n in need)
    assert (token_files.unpack_ids(image, offsets, 256) == x).all()


def test_plan_fits_histogram():
    rng = np.random.default_rng(0)
    hist = np.bincount(rng.integers(1, 2048, 5000), minlength=2048)
    rows, n = packing.plan(hist, 2048)
    used = np.zeros(2048, int)
    seqs = {}
    for v, first, k, seq, at in rows:
        assert first == used[v]
        used[v] += k
        for s in range(seq, seq + k):
            seqs.setdefault(s, []).append((at, v))
    assert (used <= hist).all() and len(seqs) == n
    for parts in seqs.values():
        end = 0
        for at, v in sorted(parts):
            assert at == end
            end += v
        assert end == 2048 or (len(parts) == 1 and end & (end - 1) == 0)
    assert used.sum() > 0.5 * hist.sum()


def test_binomial_bound_is_exact(spark):
    cases = [(0, 10), (0, 700), (3, 900), (12, 3000), (40, 100_000), (9000, 1_000_000), (50, 100)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        if r["k"] >= r["n"] * 0.01:
            assert r["p"] == 1.0
            continue
        log = [math.lgamma(r["n"] + 1) - math.lgamma(j + 1) - math.lgamma(r["n"] - j + 1) + j * math.log(0.01) + (r["n"] - j) * math.log(0.99) for j in range(r["k"] + 1)]
        assert math.isclose(r["p"], math.fsum(math.exp(x) for x in log), rel_tol=1e-6)


def test_cutoffs_hold_their_risk(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        good = rng.random() < 0.8
        rows.append((i, "s", False, float(rng.beta(1, 200) if good else rng.beta(4, 8)), 0.0, 0.0, 5.0, 0.0, 0.0, int(good)))
    names = "doc_id long, stratum string, base_failed boolean, symbol_share double, dup_line_share double, repeat_share double, mean_word double, mark_share double, upper_share double, quality int"
    df = spark.createDataFrame(rows, names)
    cut = quality_rules.calibrate(df, df.select("doc_id", "quality"), "stratum", risk=0.01)
    found = cut.collect()
    assert [r["stat"] for r in found] == ["symbol_share"]
    assert found[0]["n_rejected"] <= 0.01 * found[0]["n_good"]
    # eighty good rows can't prove a risk of one per cent
    assert quality_rules.calibrate(df.limit(80), df.select("doc_id", "quality"), "stratum").count() == 0


def test_cutoffs_together_hold_their_risk(spark):
    """Each of two statistics rejects 0.7 per cent of the good rows alone, both of them 1.4."""
    rows = []
    for i in range(40_000):
        good = i < 30_000
        a, b = (i < 210, 210 <= i < 420) if good else (i % 2 == 0, i % 2 == 1 and i % 10 < 8)
        rows.append((i, "s", False, 0.5 if a else 0.0, 0.9 if b else 0.0, 0.0, 5.0, 0.0, 0.0, int(good)))
    names = "doc_id long, stratum string, base_failed boolean, symbol_share double, dup_line_share double, repeat_share double, mean_word double, mark_share double, upper_share double, quality int"
    df = spark.createDataFrame(rows, names)
    found = {risk: {r["stat"]: r["n_rejected"] / r["n_good"] for r in quality_rules.calibrate(df, df.select("doc_id", "quality"), "stratum", risk=risk).collect()} for risk in (0.01, 0.03)}
    assert found[0.01].keys() == {"symbol_share"} and found[0.01]["symbol_share"] < 0.01
    assert found[0.03].keys() == {"symbol_share", "dup_line_share"} and 0.01 < found[0.03]["dup_line_share"] < 0.02


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def swapped(a, b):
    return len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=3, max_size=8))
def test_automaton_matches_edit_distance(word):
    terms = ["abcab", "aabbc", "cabcab", "bcabca", "abc", "abac"]
    t = toxicity.Trie(terms)
    one = lambda x: word != x and swapped(word, x)
    near = sorted((0 if word == x else 1, x) for x in terms if (len(x) >= 5 and (edits(word, x) <= 1 or one(x))) or (len(x) == 4 and (word == x or one(x))))
    assert t.near(word) == ((near[0][1], near[0][0]) if near else None)


def test_quotation_counts_apart():
    from tessel.llm._words import word_slices

    m = toxicity.Matcher(toxicity.Model({"stupid": 5.0}, {}))
    texts = pa.array(["you are stupid", 'he said "you are stupid" today', "you are stuqid", "fine words", None])
    x = np.concatenate([toxicity.features(w, m) for w in word_slices(texts)])
    assert x[0, 0] > 0 and x[0, 3] == 0
    assert x[1, 0] == 0 and x[1, 3] > 0 and x[1, 6] > 0
    assert x[2, 2] > 0 and x[2, 0] == 0
    assert not x[3].any() and not x[4].any()
    inside = lambda t: toxicity.quoted(t.split(), [i for i, v in enumerate(t.split()) if "stupid" in v][0])
    assert not inside('a 5" pipe and more . you are stupid') and not inside('"no" you are stupid "yes"') and not inside('you are stupid "yes"') and not inside('"you are stupid')
    assert inside('"stupid"') and inside("« you are stupid »") and inside("„du bist stupid“, sagte") and inside('("stupid").') and inside("he wrote “you are stupid” there")


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(80)]
    y = np.array([1.0 if 3 in r or 5 in r else -1.0 for r in rows])
    vals = [np.ones(5) / math.sqrt(5) for _ in rows]
    cost = np.full(80, 1.0)
    w = quality_classifier.dual_descent(rows, vals, y, cost, 20, epochs=400)

    def primal(w):
        return 0.5 * w @ w + sum(max(0.0, 1 - t * (w[r] @ v + w[-1])) for r, v, t in zip(rows, vals, y))

    base = primal(w)
    for _ in range(200):
        assert primal(w + rng.normal(0, 0.02, 21)) >= base - 1e-3


def test_shapes():
    assert quality_classifier.shape("THE,!!") == "A,!!" and quality_classifier.shape("erhei***") == "a***" and quality_classifier.shape("Then") == "Aa"


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def wrapper_of(*pages):
    return html_extraction.infer([html_extraction.parse(x).kids for x in pages])


def test_wrapper_alignment():
    a = "<body><nav><ul><li>x<li>y</ul></nav><article><h1>t</h1><p>one</p></article></body>"
    b = "<body><nav><ul><li>x</ul></nav><aside>z</aside><article><h1>t</h1><p>one</p><p>two</p></article></body>"
    w = wrapper_of(a, b)
    body = w.kids[0].kids
    assert [(k.kind, k.mult) for k in body] == [("nav", "1"), ("aside", "?"), ("article", "1")]
    assert [(k.kind, k.mult) for k in body[2].kids] == [("h1", "1"), ("p", "+")]
    again = html_extraction.infer([w.kids, html_extraction.parse(a).kids])
    assert html_extraction.dump(again) == html_extraction.dump(w) == html_extraction.dump(html_extraction.load(html_extraction.dump(w)))
    swapped = wrapper_of(b, a).kids[0].kids
    assert [(k.kind, k.mult) for k in swapped] == [("nav", "1"), ("aside", "?"), ("article", "1")]
    group = wrapper_of("<main>" + "<h2>t</h2><p>x</p><p>y</p>" * 3 + "<ul><li>z</ul></main>").kids[0].kids
    assert [(k.kind, k.mult) for k in group] == [("(h2 p)", "+"), ("ul", "1")] and [(k.kind, k.mult) for k in group[0].kids] == [("h2", "1"), ("p", "+")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_alignment_is_a_longest_common_subsequence(a, b):
    pairs = html_extraction.match(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) == best[-1][-1]


def read(html, wrapper=None):
    return html_extraction.read_page(html_extraction.parse(html), wrapper)


def test_page_reading():
    s = "<html><head><title>T</title></head><body><header>Site</header><div class='ad'>buy</div><div class='content-body'><h1>A &amp; B</h1><p>x<br>y  z<script>q()</script> end<p>&lt;tag&gt;<form>mail</form><div class='comments'>hi</div></div><footer>f</footer>"
    assert read(s) == "A & B\nx y z end\n<tag>"
    deep = "<article>" + "<div>" * 3000 + "<p>in</p>deep" + "</div>" * 3000 + "<p>after</article>out"
    assert read(deep) == "in\ndeep\nafter"
    menu = "<article>in" + "<div>" * 130 + "<nav>MENU</nav><aside>SIDE</aside>" + "</div>" * 130 + "<p>after</article>"
    assert read(menu) == "in\nafter"
    assert read("<form><div><article><p>text</p></article></div></form>") == "text"
    long = "<article>" + "".join(f"<h2>head {i}</h2><p>text {i}</p>" + ("<ul><li>a<li>b</ul>" if i % 3 else "") for i in range(4000)) + "</article>"
    assert read(long).count("\n") + 1 == 4000 * 2 + 2 * sum(i % 3 > 0 for i in range(4000))


def test_roles_come_from_the_wrapper():
    """No element says what the article is: what varies over the host's pages is content, what doesn't is template."""
    page = lambda i: f"<body><div><div><a href=x>Home</a> <a href=y>Shop</a></div><div>Our house rules, the same on every page of this host.</div><div><p>text {i} of the page</p><p>more {i} text that varies</p><p>Signed, the editors</p></div><div>All rights reserved by the owners of this host</div></div></body>"
    pages = [html_extraction.parse(page(i)) for i in range(4)]
    w = html_extraction.load(html_extraction.dump(html_extraction.infer([x.kids for x in pages])))
    seen = [html_extraction.slot_texts(x, w) for x in pages]
    stats = {i: (sum(i in s for s in seen), len({s[i][0] for s in seen if i in s}) > 1, sum(s[i][1] for s in seen if i in s), sum(s[i][2] for s in seen if i in s)) for i in {i for s in seen for i in s}}
    html_extraction.roles(w, stats)
    got = html_extraction.read_page(pages[2], w)
    assert "text 2 of the page\nmore 2 text that varies" in got and "house rules" not in got and "rights" not in got and "Shop" not in got
    assert html_extraction.read_page(pages[2], None) != got  # without the host's wrapper the notice and the footer can't be told apart


def test_long_words_are_read_to_their_end():
    """Text without spaces: what stands at its end counts, wherever it begins."""
    from tessel.llm._words import word_slices

    def places(text):
        (w,) = word_slices(pa.array([text]))
        return set(quality_classifier.indicators(w, quality_classifier.Shaper())[1].tolist())

    for base in ("日本語の文。" * 200, "".join(f"x{i}=Y;" for i in range(300)), "q" * 5000, "aB3" * 40, "abcdefgh.IJ"):
        junk = places(base + "###***$$$") - places(base)
        assert junk and places("xx" + base + "###***$$$") - places("xx" + base)
    assert places("日本語の文。" * 200 + "日本***") & (places("erhei***") - places("erhei"))
    assert "".join(quality_classifier.pieces("日本。" * 50 + "!?")) == "a。" * 50 + "!?"
    assert quality_classifier.pieces("THE,!!!!!") == ["A,!!!"] and quality_classifier.pieces("Then") == ["Aa"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "the", "ing", " ", " ", "  ", "\n", "\t", "\r\n", ".", ",", "!", "'s", "1", "é", "日本", "😀", "\u00a0", "\u3000", "\x1c", "\x85", "\x0b", "<|endoftext|>", "\x00", "\x02", "’", "×", "$$"]), max_size=20).map("".join) | st.none(), max_size=8))
def test_encoder_matches_library(texts):
    import public_tokenizers

    from tessel.llm._tokens import encoder

    e = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    flat, offs = e.encode(pa.array(texts, pa.string()), 7)
    assert [flat[a:z].tolist() for a, z in zip(offs, offs[1:])] == [[*x.ids, 7] for x in e.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a  b \n c 日本 \U0001f600", "    x   y", " ", "aaaa aaaaaaaa $$$ $$$$$", "hello world's 12345", "\t\tfoo(bar)", "ﬁne ▁x"])
def test_transducer_matches_library(text):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    t = sentencepiece_fst.transducer(path)
    assert np.frombuffer(t.encode(text), "<u4").tolist() == sp.encode(text)
    assert t.decode(t.encode(text)) == text.replace("▁", " ")


@settings(max_examples=80, deadline=None)
@given(st.text("abeht ing\u2581é日", min_size=1, max_size=9))
def test_unigram_path_is_the_lightest(text):
    """The tropical shortest path of a one-state grammar against all ways to cut the text."""
    import public_tokenizers

    t = sentencepiece_fst.transducer(public_tokenizers.path("piece_bpe_32k.model"), "unigram")

    def weight(steps):
        return sum(t.outside if i < 0 else -t.score[i] for _, _, i in steps)

    def least(at, seen={}):
        if at == len(text):
            return 0.0
        ways = [(z, -t.score[t.ids[text[at:z]]]) for z in range(at + 1, len(text) + 1) if text[at:z] in t.ids]
        if text[at] not in t.ids:
            ways.append((at + 1, t.outside))
        return min(w + least(z) for z, w in ways)

    steps = t._lightest(text)
    assert [a for a, _, _ in steps] == [0, *(z for _, z, _ in steps[:-1])] and steps[-1][1] == len(text)
    assert math.isclose(weight(steps), least(0))
    assert t.decode(t.path(text)) == (text.replace("\u2581", " ")[1:] if text[0] in " \u2581" else text.replace("\u2581", " "))


def test_path_of_unmergeable_pieces():
    import public_tokenizers

    t = sentencepiece_fst.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    t._side_by_side = lambda a, b: False
    assert [t.pieces[i] if i >= 0 else "" for _, _, i in t._lightest("qzé")] == ["q", "z", "é"]


@functools.cache
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.text("aehinorst .,'1é日\n\u2581\U0001f600", max_size=40))
def test_merge_path_is_the_encoding(text):
    """Tropical relaxation over the merge grammar against the library."""
    import public_tokenizers

    t = sentencepiece_fst.transducer(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.frombuffer(t.encode(text), "<u4").tolist() == library().encode(text)
    assert (t.decode(t.encode(text)) == text) == ("\u2581" not in text)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_normaliser_is_compiled_from_the_model(rule):
    """Every rule of the character map, its neighbours, white space and all single characters of a few planes, against the library's normaliser."""
    import sentencepiece

    for pad, squeeze, escape in [(1, 1, 1), (0, 0, 1), (1, 0, 0), (0, 1, 0)]:
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=bool(pad), remove_extra_whitespaces=bool(squeeze), escape_whitespaces=bool(escape))
        mine = sentencepiece_fst.Normaliser(lib.serialized_model_proto())
        assert (mine.pad, mine.squeeze, mine.space == "\u2581") == (bool(pad), bool(squeeze), bool(escape))
        rng = np.random.default_rng(0)
        texts = ["", " ", "  a   b ", "\u3000 x\u00a0\u00a0y\t\n", "ﬁne ① ｱﾞ e\u0301 Å ㌔ ½ \u200b\ufeff", "가각 ÀÉ ſ İ"]
        texts += ["".join(map(chr, x)) for x in rng.integers(32, 0x3400, (300, 8)).tolist()] + ["".join(map(chr, x)) for x in rng.integers(0xF900, 0xFFF0, (100, 6)).tolist()]
        assert [mine(x) for x in texts] == [lib.normalize(x) for x in texts]


def test_user_defined_symbols_are_refused():
    piece = b"\x0a\x01x\x18\x04"
    with pytest.raises(ValueError):
        sentencepiece_fst.Normaliser(b"\x0a" + bytes([len(piece)]) + piece)

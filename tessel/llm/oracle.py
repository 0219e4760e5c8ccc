"""SQL (DuckDB) that computes the same as the registered queries, written on its own, where SQL can express them."""

from __future__ import annotations

from .quality_rules import RULES

GAP = r"[\x20\x09-\x0D]+"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{GAP}'), lambda x: x <> '')"


OP3 = f"""WITH RECURSIVE p AS (SELECT doc_id, {_words(LOW)} AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(ws[s + 1:s + 4], ' ') AS k FROM p, unnest(range(CASE WHEN len(ws) >= 4 THEN len(ws) - 3 WHEN len(ws) > 0 THEN 1 ELSE 0 END)) t(s)),
 n AS (SELECT p.doc_id, count(k) AS n FROM p LEFT JOIN g ON g.doc_id = p.doc_id GROUP BY 1),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 c AS (SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2)
 SELECT doc_id, n_shingles, component_id FROM c"""

OP7 = f"""WITH p AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
 f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM (SELECT doc_id, s, array_to_string(ws[s + 1:s + 20], ' ') AS k FROM p, unnest(range(greatest(len(ws) - 19, 0))) t(s))),
 d AS (SELECT DISTINCT doc_id, s + o AS i FROM f, (SELECT unnest(range(20)) AS o) WHERE r > 1),
 w AS (SELECT doc_id, i, ws[i + 1] AS x FROM p, unnest(range(len(ws))) t(i)),
 k AS (SELECT w.doc_id, count(d.i) AS gone, coalesce(string_agg(x, ' ' ORDER BY w.i) FILTER (WHERE d.i IS NULL), '') AS kept FROM w LEFT JOIN d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY 1)
 SELECT p.doc_id, len(ws) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM p LEFT JOIN k ON k.doc_id = p.doc_id"""


def _crc32(text: str) -> str:
    bits = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(a, b))"
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT)), lambda a, b: {bits}, CAST(4294967295 AS BIGINT)))"


def _op10(risk: float = 0.01, delta: float = 0.05) -> str:
    cells = [(i, s, a, c) for i, (s, a, cuts) in enumerate(RULES) for c in cuts]
    bad = lambda s, a, c: f"{s} {'>' if a else '<'} {c}"
    less = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    counted = " UNION ALL ".join(f"SELECT stratum, {i} AS rule, CAST({c} AS DOUBLE) AS cut, {a} AS above, count(*) FILTER (q = 1 AND NOT proves) AS n, count(*) FILTER (q = 0 AND NOT proves) AS nb, count(*) FILTER (q = 1 AND proves) AS np, count(*) FILTER (q = 1 AND NOT proves AND {bad(s, a, c)}) AS g, count(*) FILTER (q = 0 AND NOT proves AND {bad(s, a, c)}) AS b FROM lab GROUP BY 1" for i, s, a, c in cells)
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"
    tail = lambda g, n: f"list_sum(list_transform(range(0, {g} + 1), lambda j: exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + j * ln({risk}) + ({n} - j) * ln({1 - risk}))))"
    cdf = lambda g, n: f"CASE WHEN {g} >= {n} * {risk} THEN 1 ELSE {tail(g, n)} END"
    hit = " OR ".join(f"(rule = {i} AND {s} {'>' if a else '<'} cut)" for i, (s, a, _) in enumerate(RULES))
    return f"""WITH p AS (SELECT doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS ws FROM documents),
 tri AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS m FROM (SELECT doc_id, s, array_to_string(ws[s + 1:s + 3], ' ') AS k FROM p, unnest(range(greatest(len(ws) - 2, 0))) u(s))),
 rep AS (SELECT doc_id, count(DISTINCT s + o) AS r FROM tri, (SELECT unnest(range(3)) AS o) WHERE m > 1 GROUP BY 1),
 ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM p) WHERE regexp_replace(x, '{GAP}', '', 'g') <> '' GROUP BY 1),
 s0 AS (SELECT p.doc_id, stratum, len(ws) AS n_words, length(regexp_replace(t, '{GAP}', '', 'g')) AS word_chars, {less('#*$%&|<>')} AS n_symbols, {less('!?')} AS marks, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper_n, coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM p LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
 st AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {share('n_symbols', 'word_chars')} AS symbol_share, {share('n_dup_lines', 'n_lines')} AS dup_line_share, {share('n_repeat_words', 'n_words')} AS repeat_share, {share('word_chars', 'n_words')} AS mean_word, {share('marks', 'word_chars')} AS mark_share, {share('upper_n', 'word_chars')} AS upper_share FROM s0),
 lab AS (SELECT st.*, q, crc % 2 = 1 AS proves FROM st JOIN (SELECT doc_id, crc, max(quality) AS q FROM (SELECT *, {_crc32('CAST(doc_id AS VARCHAR)')} AS crc FROM labels) WHERE quality IS NOT NULL AND crc % 5 <> 0 GROUP BY 1, 2) l USING (doc_id) WHERE NOT base_failed),
 cnt AS ({counted}),
 safe AS (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY CASE WHEN above THEN cut ELSE -cut END) AS strict FROM cnt WHERE n > 0 AND b * n > g * nb AND {cdf("g", "n")} <= {delta}),
 one AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY b DESC, rule) AS place FROM safe WHERE strict = 1),
 fst AS (SELECT doc_id, lab.stratum, min(place) AS place FROM lab JOIN one ON one.stratum = lab.stratum AND ({hit}) WHERE q = 1 AND proves GROUP BY 1, 2),
 tog AS (SELECT stratum, rule, cut, np, (SELECT count(*) FROM fst WHERE fst.stratum = one.stratum AND fst.place <= one.place) AS m FROM one),
 used AS (SELECT stratum, rule, cut FROM tog WHERE np > 0 AND ({cdf("m", "np")}) * (SELECT count(DISTINCT stratum) FROM lab) <= {delta})
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM used WHERE used.stratum = st.stratum AND ({hit})) AS kept, stratum FROM st"""


OP11 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 s AS (SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same, CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: a.x[i] * v.x[i])) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id),
 p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
 n AS (SELECT p.a, p.b, s.b AS c, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
 SELECT a AS anchor_id, b AS positive_id, CAST(r AS INTEGER) AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5"""

#: The level of the shares is found among the sources by falling need: the first k are at their limit, the rest share what they leave.
OP12 = f"""WITH d AS (SELECT doc_id, source, len({_words("coalesce(text, '')")}) AS size, md5(concat('0|', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY 1),
 o AS (SELECT *, 3 * source_size AS most, sum(3 * source_size) OVER q - 3 * source_size AS capped, sum(w) OVER () - (sum(w) OVER q - w) AS ws, sum(source_size) OVER () AS t FROM s WINDOW q AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT max(lv) AS lv FROM (SELECT CAST(t - capped AS DOUBLE) / CAST(ws AS DOUBLE) AS lv, w, most FROM o) WHERE most > w * lv),
 g AS (SELECT source, source_size, CASE WHEN lv IS NULL OR most <= w * lv THEN CAST(most AS DOUBLE) ELSE w * lv END AS target FROM o, l),
 b AS (SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(round(target) AS BIGINT) AS budget, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
 SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS whole, CASE WHEN source_size = 0 THEN 0 ELSE least(size, greatest(0, budget % source_size - before)) END AS part, whole * size + part AS taken FROM b"""


ORACLE_SQL = {"op3_jaccard_join": OP3, "op7_substring_dedup": OP7, "op10_quality_rules": _op10(), "op11_hard_negatives": OP11, "op12_mixing": OP12}

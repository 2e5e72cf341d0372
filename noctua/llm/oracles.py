"""DuckDB SQL for the operators that SQL can express; written from the definitions, not from the Spark code."""

from __future__ import annotations

_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""


def _op8() -> str:
    cover = []
    for n in (3, 5, 7, 10):
        ahead = " || ' ' || ".join(f"lead(w, {i}) OVER o" for i in range(n))
        cover.append(f"""
g{n} AS (SELECT doc_id, pos, w, gram, count(gram) OVER (PARTITION BY doc_id, gram) > 1 AND gram IS NOT NULL AS twice
         FROM (SELECT doc_id, pos, w, {ahead} AS gram FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY pos))),
c{n} AS (SELECT doc_id, sum(hit::INT)::BIGINT AS n_hit, sum(CASE WHEN hit THEN length(w) ELSE 0 END) AS chars
         FROM (SELECT doc_id, w, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM g{n})
         GROUP BY doc_id)""")
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM doc),
line AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM doc)
         WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
lines AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines, sum((n - 1) * length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS dup_chars FROM line GROUP BY doc_id),
{",".join(cover)},
base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup_chars, 0) AS dup_chars,
         coalesce(c3.n_hit, 0)::BIGINT AS n_repeat_words, c5.chars AS x5, c7.chars AS x7, c10.chars AS x10,
         len(list_filter(ws, lambda w: regexp_matches(w, '[A-Z].*[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS n_capital
         FROM doc d LEFT JOIN lines USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c7 USING (doc_id) LEFT JOIN c10 USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(word_chars, 1)::DOUBLE AS least FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND dup_chars / least <= 0.40 AND n_symbols <= 0.05 * word_chars::DOUBLE AND n_capital <= 0.60 * n_words::DOUBLE
       AND coalesce(x5, 0) / least <= 0.40 AND coalesce(x7, 0) / least <= 0.35 AND coalesce(x10, 0) / least <= 0.30 AS kept
FROM judged"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS s FROM iw),
dwin AS (SELECT doc_id, size, unnest(CASE WHEN len(w) < size THEN [] ELSE list_transform(range(1, len(w) - size + 2), lambda i: [i::VARCHAR, array_to_string(w[i:i + size - 1], ' ')]) END) AS p
         FROM dw, (SELECT DISTINCT size FROM win)),
hit AS (SELECT DISTINCT d.doc_id, p[1]::BIGINT AS lo, d.size, item_id FROM dwin d JOIN win ON win.size = d.size AND win.s = p[2]),
covered AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(lo, lo + size)) AS x FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN item USING (doc_id)"""

_OP3 = r"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM ws)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
overlap AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM overlap o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)"""

_OP5 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)"""

_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id < page_id THEN first_id END AS refers_to, NULL::VARCHAR AS error FROM f"""

_OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
mark AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true)::INT AS new FROM again),
isle AS (SELECT doc_id, n, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM mark) GROUP BY doc_id, n),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM isle),
cut AS (SELECT g.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
known AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
       'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS x FROM w LEFT JOIN known USING (doc_id)),
fails AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: x[c]) AS failed, count(*) AS n FROM (SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [x.A, x.B, x.C, x.D, x.E]) AS x FROM f) GROUP BY ALL),
letter(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM letter a, letter b, letter d, letter e, letter g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
place AS (SELECT o, step, substr(o, step, 1) AS c, string_split(substr(o, 1, step - 1), '') AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
run AS (SELECT part, o, step, c, good, toxic, n, failed, list_contains(failed, c) AS here, len(list_intersect(failed, earlier)) > 0 AS gone FROM fails, place),
seen AS (SELECT part, o AS filter_order, step::INT AS step, c, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = [c]), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (here AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (here AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM run GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM seen"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 30),
own AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
grp AS (SELECT DISTINCT lang, source FROM d),
lang_n AS (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY 1),
grp_n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS total FROM grp g LEFT JOIN own USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 5)) // (g.total + 5 * l.v)::HUGEINT AS p,
      1 + (1000000000::HUGEINT * (k.c + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
      FROM grp_n g JOIN lang_n l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
         UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM lang_n)),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

SQL = {"op12_filter_audit": _OP12, "op13_source_audit": _OP13, "op9_suffix_dedup": _OP9, "op4_warc": _OP4, "op5_url_filter": _OP5, "op2_decontaminate": _OP2, "op3_minhash_dedup": _OP3, "op8_quality_rules": _op8()}

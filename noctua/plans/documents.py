"""Registered queries of document processing and text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctua.functions import dims, text
from noctua.operators import documents
from noctua.sources.driver import CHUNKS, with_

from .base import query
from .retrieval import term_set

_T = "documents"


def _second_half():
    return F.expr("substring(text, cast(length(text) div 2 as int) + 1)")


_HTML = r"""replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)</?(p|div|br|li|h[1-6]|section|article)[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''')"""
_SPACED = "trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_MD = _SPACED.format(c="regexp_replace(regexp_replace(regexp_replace({c}, '\\[([^\\]]+)\\]\\([^\\)]+\\)', '\\1', 'g'), '<[^>]+>', ' ', 'g'), '^[*_`]+|[*_`]+$', '', 'g')")
_TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query("C1_html_to_text", f"SELECT page_id, {_HTML.format(c='html')} AS text FROM pages")
def c1(t):
    return t.pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))


_SPLICED = "'**' || text || ' [' || doc_id || '](http://x/' || doc_id || ') <b>bold</b>  `' || text || '`'"


def _spliced():
    i = F.col("doc_id").cast("string")
    return F.concat(F.lit("**"), "text", F.lit(" ["), i, F.lit("](http://x/"), i, F.lit(") <b>bold</b>  `"), "text", F.lit("`"))


@query("C2_clean_markdown", f"SELECT doc_id, {_MD.format(c='s')} AS clean FROM (SELECT doc_id, {_SPLICED} AS s FROM documents)")
def c2(t):
    return t.documents.select("doc_id", text.clean_markdown(_spliced()).alias("clean"))


@query(
    "C3_sentences",
    f"""WITH RECURSIVE d AS (SELECT doc_id, {_TRIM.format(c="text")} AS s FROM documents), cut AS (SELECT doc_id, s, list_filter(range(1, length(s)), lambda i: regexp_matches(substr(s, i, 2), '^[.!?]\\s')) AS ends FROM d),
fold AS (SELECT doc_id, s, ends, 0::BIGINT AS k, 0::BIGINT AS p0, []::VARCHAR[] AS out FROM cut WHERE length(s) > 320 UNION ALL
SELECT doc_id, s, ends, k + 1, CASE WHEN ends[k + 1] - 1 - p0 >= 45 THEN ends[k + 1] ELSE p0 END, CASE WHEN ends[k + 1] - 1 - p0 >= 45 THEN list_append(out, substr(s, p0 + 1, ends[k + 1] - p0)) ELSE out END FROM fold WHERE k < len(ends)),
done AS (SELECT doc_id, CASE WHEN p0 < length(s) THEN list_append(out, substr(s, p0 + 1)) ELSE out END AS out FROM fold WHERE k = len(ends))
SELECT doc_id, list_filter(list_transform(out, lambda x: {_TRIM.format(c="x")}), lambda x: length(x) >= 45) AS sentences FROM done UNION ALL SELECT doc_id, [s] FROM cut WHERE length(s) <= 320""",
)
def c3(t):
    return t.documents.select("doc_id", documents.sentences(F.col("text")).alias("sentences"))


_CLAIM = "text || CASE doc_id % 4 WHEN 0 THEN ' authentication is required with a JWT' WHEN 1 THEN ' we decided on 2026-05-01, for example `x`' WHEN 2 THEN ' the endpoint must support POST /x' ELSE '' END"


def _claim():
    k = F.col("doc_id") % 4
    end = F.when(k == 0, " authentication is required with a JWT").when(k == 1, " we decided on 2026-05-01, for example `x`").when(k == 2, " the endpoint must support POST /x").otherwise("")
    return F.concat("text", end)


_LOW = "translate('notes ' || s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_POINTS = " + ".join(f"CASE WHEN contains(low, '{k}') THEN {v} ELSE 0 END" for k, v in dims.CLAIM_POINTS.items())


@query(
    "C4_claim_scores",
    f"""WITH c AS (SELECT doc_id, s, {_LOW} AS low FROM (SELECT doc_id, {_TRIM.format(c=_CLAIM)} AS s FROM documents)), p AS (SELECT *, 10 + {_POINTS} + CASE WHEN regexp_matches(s, '\\b20\\d{{2}}-\\d{{2}}-\\d{{2}}\\b') THEN 12 ELSE 0 END
+ CASE WHEN contains(s, '`') OR contains(s, 'POST /') OR contains(s, 'GET /') THEN 8 ELSE 0 END - CASE WHEN contains(low, 'example') THEN 7 ELSE 0 END AS score FROM c)
SELECT doc_id, CASE WHEN length(s) BETWEEN 45 AND 1000 AND NOT starts_with(s, '{{') AND score >= 16 THEN score END AS score, contains(low, 'we decided') OR contains(low, 'it was decided') OR contains(low, 'approved decision') OR contains(low, 'we agreed') AS decision FROM p""",
)
def c4(t):
    head = F.lit("notes")
    return t.documents.select("doc_id", documents.claim_score(head, _claim()).alias("score"), documents.is_decision(head, _claim()).alias("decision"))


@query("C5_candidates")
def c5(t):
    """Candidates of documents made of spliced claims under headings."""
    d = t.documents.select("doc_id", F.concat(F.lit("Notes "), "lang").alias("title"), F.concat(F.lit("# Setup\n- "), _claim(), F.lit("\n- "), F.col("text"), F.lit(" must be enabled\n\n## Decisions\n"), _claim(), F.lit(".\n```\ncode\n```\n")).alias("text"))
    return documents.candidates(d, "doc_id", "title", "text")


@query("C6_markdown_blocks")
def c6(t):
    return documents.blocks(t.documents, "doc_id", "text")


@query("C7_chunks", CHUNKS)
def c7(t):
    return documents.chunked(t.documents.select("doc_id", "text"))


@query("C8_pdf_text", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text || '  ' || chr(12) || ' x ' || chr(10) || 'y  ', chr(0), ''), chr(12), chr(10) || chr(10)), '[ \t\r]+(\n|$)', '\1', 'g'), '^\s+', ''), '\s+$', '') AS text FROM documents")
def c8(t):
    return t.documents.select("doc_id", documents.pdf_text(F.concat("text", F.lit("  \x0c x \ny  "))).alias("text"))


_SPACED_OUT = "CASE WHEN doc_id % 10 = 3 THEN regexp_replace(left(text, 60), '(.)', '\\1 ', 'g') || text WHEN doc_id % 10 = 4 THEN left(text, 30) || chr(65533) ELSE text END"
_Q = rf"""WITH d AS (SELECT doc_id, {_SPACED_OUT} AS s FROM documents), f AS (SELECT doc_id, length(regexp_replace(s, '\s', '', 'g')) AS visible, length(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum, length(regexp_replace(s, '[^\x{{FFFD}}]', '', 'g')) AS bad,
list_filter(list_transform(string_split_regex(s, '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda x: x <> '') AS cores FROM d),
g AS (SELECT *, len(cores) AS tokens, len(list_filter(cores, lambda x: length(x) = 1)) AS singles, coalesce(list_max(list_transform(string_split(array_to_string(list_transform(cores, lambda x: CASE WHEN length(x) = 1 THEN '1' ELSE '0' END), ''), '0'), lambda x: length(x))), 0) AS run FROM f),
r AS (SELECT *, CASE WHEN tokens = 0 THEN 1.0 ELSE singles / tokens END AS ratio, CASE WHEN visible = 0 THEN 0.0 ELSE alnum / visible END AS share FROM g),
s AS (SELECT *, greatest(0, least(100, 100 - CASE WHEN visible < 40 OR tokens < 8 THEN 65 ELSE 0 END - CASE WHEN run >= 8 THEN 70 WHEN run >= 5 THEN 30 ELSE 0 END - CASE WHEN tokens >= 12 AND ratio > 0.22 THEN 55 WHEN tokens >= 12 AND ratio > 0.12 THEN 20 ELSE 0 END
- CASE WHEN share < 0.45 THEN 35 ELSE 0 END - CASE WHEN bad > 0 THEN 30 ELSE 0 END)) AS score FROM r)"""


def _garbled():
    k = F.col("doc_id") % 10
    return F.when(k == 3, F.concat(F.regexp_replace(F.left("text", F.lit(60)), "(.)", "$1 "), "text")).when(k == 4, F.concat(F.left("text", F.lit(30)), F.lit("�"))).otherwise(F.col("text"))


@query("C9_text_quality", _Q + " SELECT doc_id, score, NOT (run >= 8 OR (tokens >= 12 AND ratio > 0.22)) AND score >= 70 AND visible >= 40 AS passed, run, singles FROM s")
def c9(t):
    q = F.col("q")
    return t.documents.select("doc_id", text.quality(_garbled()).alias("q")).select("doc_id", text.quality_score(q).alias("score"), text.quality_passed(q).alias("passed"), q["run"].cast("bigint").alias("run"), q["singles"].cast("bigint").alias("singles"))


@query(
    "C10_best_attempt",
    _Q.replace("WITH d AS (SELECT doc_id, " + _SPACED_OUT + " AS s FROM documents), f AS (SELECT doc_id,", "WITH d AS (SELECT doc_id, 1 AS engine_order, " + _SPACED_OUT + " AS s FROM documents UNION ALL SELECT doc_id, 2, text FROM documents), f AS (SELECT doc_id, engine_order,")
    + """, t AS (SELECT *, NOT (run >= 8 OR (tokens >= 12 AND ratio > 0.22)) AND score >= 70 AND visible >= 40 AS passed FROM s)
SELECT doc_id, engine_order, score, passed FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY passed DESC, CASE WHEN passed THEN engine_order END, score DESC, engine_order DESC) = 1""",
)
def c10(t):
    one = t.documents.select("doc_id", F.lit(1).alias("engine_order"), _garbled().alias("text"))
    two = t.documents.select("doc_id", F.lit(2).alias("engine_order"), "text")
    return documents.best_attempt(one.union(two), "doc_id")


_SLUG = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "C11_candidate_tags",
    f"SELECT doc_id, list_distinct_ordered AS tags FROM (SELECT doc_id, list_reduce(list_filter(string_split(CASE WHEN s = '' THEN 'document' ELSE left(s, 80) END, '-'), lambda x: strlen(x) >= 3)[1:4], lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, ['document-import']) AS list_distinct_ordered FROM (SELECT doc_id, {_SLUG.format(c='text')} AS s FROM documents))",
)
def c11(t):
    return t.documents.select("doc_id", documents.candidate_tags(F.col("text")).alias("tags"))


@query("C12_numbered_lines", r"SELECT l, n, regexp_matches(l, '^[.)]*[0-9][0-9.)]*') AND regexp_matches(l, '^[^.)]*[.)] ') AS numbered FROM (SELECT n, unnest([n || '. point', n || ') x', n || '.x', 'a' || n || '. b', '(' || n || ') c']) AS l FROM (SELECT doc_id AS n FROM documents))")
def c12(t):
    n = F.col("doc_id").cast("string")
    lines = F.array(F.concat(n, F.lit(". point")), F.concat(n, F.lit(") x")), F.concat(n, F.lit(".x")), F.concat(F.lit("a"), n, F.lit(". b")), F.concat(F.lit("("), n, F.lit(") c")))
    return t.documents.select(F.col("doc_id").alias("n"), F.explode(lines).alias("l")).withColumn("numbered", text.numbered_line(F.col("l")))


@query("C13_replaced_chunks", with_("chunks") + "SELECT id, import_id FROM x_chunks WHERE import_id <> 7 UNION ALL SELECT 1000000000000 + id, import_id FROM x_chunks WHERE import_id = 7")
def c13(t):
    """Passages after those of one import were made anew."""
    c = t.chunks.select("id", "import_id")
    new = c.where("import_id = 7").withColumn("id", F.col("id") + 1_000_000_000_000)
    return c.join(new.select("import_id").distinct(), "import_id", "left_anti").select("id", "import_id").unionByName(new)


@query("T1_truncated", "SELECT doc_id, left(text, 40) AS cut, CASE WHEN length(text) <= 64 THEN text ELSE left(text, 61) || '...' END AS title FROM documents")
def t1(t):
    return t.documents.select("doc_id", F.left("text", F.lit(40)).alias("cut"), text.truncated(F.col("text"), 64).alias("title"))


@query("T2_last_chars", "SELECT doc_id, right(text, 80) AS tail FROM documents")
def t2(t):
    return t.documents.select("doc_id", F.right("text", F.lit(80)).alias("tail"))


@query("T3_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def t3(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


_TAGS = "[' ' || split_part(text, ' ', 1), upper(replace(split_part(text, ' ', 1), 'ß', 's')), split_part(text, ' ', 2) || '/x', lang, '--' || source]"


def _tags():
    w = F.split("text", " ")
    word = lambda k: F.coalesce(F.try_element_at(w, F.lit(k)), F.lit(""))
    return F.array(F.concat(F.lit(" "), word(1)), F.upper(F.replace(word(1), F.lit('ß'), F.lit('s'))), F.concat(word(2), F.lit("/x")), F.col("lang"), F.concat(F.lit("--"), F.col("source")))


@query("T4_normal_tags", f"SELECT doc_id, list_reduce(list_filter(list_transform({_TAGS}, lambda x: regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> ''), lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, []::VARCHAR[]) AS tags FROM documents")
def t4(t):
    return t.documents.select("doc_id", text.normal_tags(_tags()).alias("tags"))


@query("T5_distinct_tags", f"SELECT doc_id, list_reduce(list_filter({_TAGS}, lambda x: trim(x) <> ''), lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) THEN a ELSE list_append(a, x) END, []::VARCHAR[]) AS tags FROM documents")
def t5(t):
    return t.documents.select("doc_id", text.distinct_tags(_tags()).alias("tags"))


@query("T6_merged_bodies", "WITH d AS (SELECT doc_id, trim(text) AS o, trim(CASE doc_id % 3 WHEN 0 THEN substr(text, length(text) // 2 + 1) WHEN 1 THEN text || ' and more' ELSE 'another note ' || doc_id END) AS n FROM documents) SELECT doc_id, CASE WHEN contains(o, n) THEN o WHEN contains(n, o) THEN n WHEN length(o || chr(10) || chr(10) || 'Update:' || chr(10) || n) > 1200 THEN n ELSE o || chr(10) || chr(10) || 'Update:' || chr(10) || n END AS body FROM d")
def t6(t):
    from noctua.operators.gate import merged_body

    new = F.when(F.col("doc_id") % 3 == 0, _second_half()).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" and more"))).otherwise(F.concat(F.lit("another note "), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", merged_body(F.col("text"), new, F.lit("fact")).alias("body"))


@query("T7_xml_escaped", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def t7(t):
    return t.pages.select("page_id", text.xml_escaped(F.col("html")).alias("escaped"))


@query("T8_flexible_dates", with_("memories") + "SELECT id, left(updated_at, 10)::DATE AS day, NULL::DATE AS none FROM x_memories")
def t8(t):
    return t.memories.select("id", text.first_date(F.col("updated_at")).alias("day"), text.first_date(F.concat(F.lit("x"), "updated_at")).alias("none"))


@query("T9_normal_space", f"SELECT doc_id, {_SPACED.format(c='text')} AS text FROM documents")
def t9(t):
    return t.documents.select("doc_id", text.normal_space(F.col("text")).alias("text"))


@query("T10_url_path", "SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages")
def t10(t):
    return t.pages.select("page_id", text.url_path(F.col("url")).alias("path"))


@query("T11_unified_diff")
def t11(t):
    """Unified diff of two wordings of each document, three lines of context."""
    d = t.documents.select("doc_id", F.col("text").alias("old"), F.replace("text", F.lit("the"), F.lit("THE")).alias("new"))
    from noctua.functions.diff import unified

    return unified(d, "doc_id", "old", "new")


@query("T12_item_ids", "SELECT doc_id, '~/p/' || doc_id || '::' || regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS id FROM documents")
def t12(t):
    from noctua.operators.catalog import item_id

    return t.documents.select("doc_id", item_id(F.concat(F.lit("/home/u/p/"), F.col("doc_id").cast("string")), "/home/u", F.col("text")).alias("id"))


@query("T13_json_paths", with_("agent_lines") + "SELECT task_id, seq, CASE WHEN line LIKE '{%' THEN line ->> '$.item.type' END AS item_type, CASE WHEN line LIKE '{%' THEN (line ->> '$.usage.output_tokens')::BIGINT END AS output_tokens, CASE WHEN line LIKE '{%' THEN line ->> '$.error.message' END AS error FROM x_agent_lines")
def t13(t):
    get = lambda p: F.get_json_object("line", p)
    return t.agent_lines.select("task_id", "seq", get("$.item.type").alias("item_type"), get("$.usage.output_tokens").cast("bigint").alias("output_tokens"), get("$.error.message").alias("error"))


@query("T16_base64", "SELECT doc_id, base64(encode(text)) AS code, text AS back FROM documents")
def t16(t):
    code = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    return t.documents.select("doc_id", code.alias("code"), F.decode(F.unbase64(code), "UTF-8").alias("back"))


@query("T17_markdown_summary", "SELECT doc_id, 'First line ' || doc_id AS summary FROM documents")
def t17(t):
    from noctua.operators.catalog import markdown_summary

    i = F.col("doc_id").cast("string")
    return t.documents.select("doc_id", markdown_summary(F.concat(F.lit("---\nid: x\n---\n# "), F.col("lang"), F.lit("\n\n  First line "), i, F.lit("  \nmore"))).alias("summary"))


@query("T18_clean_reference", "SELECT page_id, trim(left(regexp_replace(url || chr(7) || html, '[\\x00-\\x1F\\x7F-\\x{9F}]', '', 'g'), 260)) AS reference FROM pages")
def t18(t):
    return t.pages.select("page_id", text.clean_reference(F.concat("url", F.lit("\x07"), "html")).alias("reference"))


@query("T19_content_types", "SELECT kind, starts_with(kind, 'text/') OR contains(kind, 'application/json') OR contains(kind, 'application/xml') OR contains(kind, 'application/yaml') OR contains(kind, 'application/x-yaml') OR contains(kind, 'application/markdown') AS ok FROM (SELECT event_type || '/' || event_id AS kind FROM events UNION ALL SELECT unnest(['text/html', 'application/json; x', 'image/png', 'application/x-yaml']))")
def t19(t):
    kinds = t.events.select(F.concat("event_type", F.lit("/"), F.col("event_id").cast("string")).alias("kind")).union(t.spark.createDataFrame([("text/html",), ("application/json; x",), ("image/png",), ("application/x-yaml",)], "kind string"))
    return kinds.select("kind", text.text_content_type(F.col("kind")).alias("ok"))


_V4 = "a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a = 127 OR (a = 169 AND b = 254) OR a >= 224 OR a = 0 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)"
_FIRST = (0x2001, 0x2A00, 0xFC00, 0xFDFF, 0xFE80, 0xFEBF, 0xFEC0, 0xFF02)


@query(
    "T20_public_addresses",
    f"""WITH e AS (SELECT event_id, event_id * 7 % 256 AS a, event_id * 13 % 256 AS b, event_id % 3 AS c, event_id % 256 AS d, {list(_FIRST)}[event_id % 8 + 1] AS s0, CASE WHEN event_id % 3 = 0 THEN 3512 ELSE event_id % 5000 END AS s1, event_id % 65536 AS s7 FROM events),
x AS (SELECT event_id, NOT ({_V4}) AS v4, NOT (s0 >= 65280 OR s0 BETWEEN 64512 AND 65023 OR s0 BETWEEN 65152 AND 65215 OR (s0 = 8193 AND s1 = 3512)) AS v6, a || '.' || b || '.' || c || '.' || d AS ip, format('{{:x}}:{{:x}}', s0, s1) AS head, format('{{:x}}', s7) AS tail,
 format('{{:x}}:{{:x}}', a * 256 + b, c * 256 + d) AS low FROM e)
SELECT ip, k, event_id, CASE WHEN public THEN 'public' WHEN NOT public THEN 'special' ELSE 'none' END AS verdict FROM (SELECT ip, v4 AS public, 0 AS k, event_id FROM x UNION ALL SELECT '::ffff:' || ip, v4, 1, event_id FROM x UNION ALL SELECT '::' || low, v4, 2, event_id FROM x UNION ALL SELECT head || ':0:0:0:1:0:' || tail, v6, 3, event_id FROM x
UNION ALL SELECT upper(head) || '::' || tail, v6, 4, event_id FROM x UNION ALL SELECT head || '::', v6, 5, event_id FROM x UNION ALL SELECT head || ':1:2:3:4:5', NULL, 6, event_id FROM x UNION ALL SELECT head || '::1::' || tail, NULL, 7, event_id FROM x UNION ALL SELECT head || '::' || ip, v6, 8, event_id FROM x)""",
)
def t20(t):
    """Addresses of both versions: whole, compressed, with a version 4 address inside, and two spellings that are none."""
    # numbers of events are small beside the work on what is made of them: a few files must not be a few tasks
    events = t.events.select("event_id").repartition(4 * t.spark.sparkContext.defaultParallelism, "event_id")
    e = F.col("event_id")
    a, b, c, d = e * 7 % 256, e * 13 % 256, e % 3, e % 256
    ip, hexed = F.concat_ws(".", *(x.cast("string") for x in (a, b, c, d))), lambda x: F.lower(F.hex(x.cast("bigint")))
    head = F.concat(hexed(F.get(F.array(*map(F.lit, _FIRST)), (e % 8).cast("int"))), F.lit(":"), hexed(F.when(e % 3 == 0, 3512).otherwise(e % 5000)))
    low, tail, lit = F.concat(hexed(a * 256 + b), F.lit(":"), hexed(c * 256 + d)), hexed(e % 65536), F.lit
    kinds = [ip, F.concat(lit("::ffff:"), ip), F.concat(lit("::"), low), F.concat(head, lit(":0:0:0:1:0:"), tail), F.concat(F.upper(head), lit("::"), tail), F.concat(head, lit("::")), F.concat(head, lit(":1:2:3:4:5")), F.concat(head, lit("::1::"), tail), F.concat(head, lit("::"), ip)]
    return events.select(e, F.posexplode(F.array(*kinds)).alias("k", "ip")).select("event_id", "k", "ip", text.is_public_address(F.col("ip")).alias("p")).select("event_id", "k", "ip", F.when(F.col("p"), "public").when(~F.col("p"), "special").otherwise("none").alias("verdict"))


@query("T21_safe_paths", "SELECT path, NOT (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')) AS safe FROM (SELECT unnest(['/a/' || doc_id, 'a/../' || doc_id, 'a/b..c/' || doc_id, '..']) AS path FROM documents)")
def t21(t):
    i = F.col("doc_id").cast("string")
    paths = F.array(F.concat(F.lit("/a/"), i), F.concat(F.lit("a/../"), i), F.concat(F.lit("a/b..c/"), i), F.lit(".."))
    return t.documents.select(F.explode(paths).alias("path")).select("path", text.safe_relative(F.col("path")).alias("safe"))


@query("T22_math", "SELECT event_id, round(exp(-ln(2) * (event_id % 400) / 180), 6) AS decay, greatest(0, least(1, value / 100)) AS clamped FROM events")
def t22(t):
    return t.events.select("event_id", F.round(F.exp(-F.ln(F.lit(2)) * (F.col("event_id") % 400) / 180), 6).alias("decay"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("clamped"))


@query("U1_searchable_terms", f"SELECT doc_id, list_sort({term_set('text')}) AS terms FROM documents")
def u1(t):
    return t.documents.select("doc_id", F.array_sort(text.term_set(F.col("text"))).alias("terms"))


@query("U2_normalized_terms", f"SELECT doc_id, list_sort({term_set('text', 2)}) AS terms FROM documents")
def u2(t):
    return t.documents.select("doc_id", F.array_sort(text.term_set(F.col("text"), 2)).alias("terms"))


@query("U3_word_set", "SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 3), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS words FROM documents")
def u3(t):
    return t.documents.select("doc_id", F.array_sort(text.word_set(F.col("text"))).alias("words"))


@query("U4_slugs", f"SELECT doc_id, CASE WHEN {_SLUG.format(c='text')} = '' THEN 'document' ELSE left({_SLUG.format(c='text')}, 80) END AS document_slug, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[ _-]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{{2,}}', '-', 'g'), '^-|-$', '', 'g') AS path_slug FROM documents")
def u4(t):
    return t.documents.select("doc_id", text.import_slug(F.col("text")).alias("document_slug"), text.slug(F.col("text")).alias("path_slug"))


@query("U5_jaccards", f"WITH p AS (SELECT doc_id, {term_set('text', 2)} AS a, {term_set('substr(text, length(text) // 2 + 1)', 2)} AS b FROM documents) SELECT doc_id, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) END AS jaccard FROM p")
def u5(t):
    d = t.documents.select("doc_id", text.term_set(F.col("text"), 2).alias("a"), text.term_set(_second_half(), 2).alias("b"))
    return d.select("doc_id", F.round(text.similarity(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("C14_imports", "SELECT page_id AS id, CASE WHEN page_id % 8 = 3 THEN 'secrets' END AS refusal, page_id % 8 = 3 AS rejected FROM pages")
def c14(t):
    """Imports of pages, some with a credential spliced in."""
    from noctua.operators import imports

    html = F.when(F.col("page_id") % 8 == 3, F.concat("html", F.lit("<p>password: hunter2</p>"))).otherwise(F.col("html"))
    raw = t.pages.select(F.col("page_id").alias("id"), F.lit("work").alias("domain"), F.lit("Page").alias("title"), F.lit("url").alias("input_kind"), html.alias("content"))
    return imports.imported(raw).select("id", "refusal", (F.col("status") == "rejected").alias("rejected"))


@query("S12_fetch_policy", "SELECT page_id, k, CASE WHEN k = 1 THEN 'scheme' WHEN k = 2 THEN 'credentials' WHEN k BETWEEN 3 AND 9 THEN 'not public' WHEN k = 10 THEN 'invalid' END AS refusal FROM pages, (SELECT unnest(range(0, 13)::INT[]) AS k)")
def s12(t):
    i = F.col("page_id").cast("string")
    refused = ("ftp://a.b/", "http://u:p@a.b/", "https://x.localhost:80/", "http://10.0.0.1/", "http://[::1]/", "http://[fe80::1]:80/", "http://[::ffff:10.0.0.1]/", "http://[::g]/", "http://127.1/", "a.b/", "http://[2a00:1450::8]:443/", "http://8.8.8.8/")
    kinds = F.array(F.col("url"), *(F.concat(F.lit(x), i) for x in refused))
    return t.pages.select("page_id", F.posexplode(kinds).alias("k", "u")).select("page_id", "k", text.fetch_refusal(F.col("u")).alias("refusal"))


@query("S7_bounded_read", "SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN text END AS content FROM documents")
def s7(t):
    return t.documents.select("doc_id", F.when(F.octet_length("text") <= 4096, F.col("text")).alias("content"))


@query(
    "T14_display_numbers",
    """WITH n AS (SELECT o_orderkey AS k, (o_orderkey * 7919) % 3000000 AS v, ((o_orderkey * 104729) % 400000) - 200000 AS s FROM orders)
SELECT k, CASE WHEN v >= 999950 THEN regexp_replace(printf('%.1f', round(v / 1000000.0, 1)), '\\.0$', '') || 'M' WHEN v >= 10000 THEN regexp_replace(printf('%.1f', round(v / 1000.0, 1)), '\\.0$', '') || 'K' ELSE format('{:,}', v) END AS shown,
CASE WHEN abs(s) < 60 THEN 'just now' WHEN abs(s) >= 86400 AND floor(s / 86400.0 + 0.5) = -1 THEN 'yesterday' WHEN abs(s) >= 86400 AND floor(s / 86400.0 + 0.5) = 1 THEN 'tomorrow'
ELSE CASE WHEN c < 0 THEN abs(c) || ' ' || u || CASE WHEN abs(c) = 1 THEN '' ELSE 's' END || ' ago' ELSE 'in ' || c || ' ' || u || CASE WHEN c = 1 THEN '' ELSE 's' END END END AS age
FROM (SELECT *, CASE WHEN abs(s) < 3600 THEN floor(s / 60.0 + 0.5) WHEN abs(s) < 86400 THEN floor(s / 3600.0 + 0.5) ELSE floor(s / 86400.0 + 0.5) END::BIGINT AS c, CASE WHEN abs(s) < 3600 THEN 'minute' WHEN abs(s) < 86400 THEN 'hour' ELSE 'day' END AS u FROM n)""",
)
def t14(t):
    from noctua.functions import display

    n = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919 % 3_000_000).alias("v"), (F.col("o_orderkey") * 104_729 % 400_000 - 200_000).alias("s"))
    return n.select("k", display.compact(F.col("v")).alias("shown"), display.relative(F.col("s")).alias("age"))

"""Registered queries of retrieval and verification, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctua.functions import dims, text
from noctua.operators import documents, search, verify
from noctua.sources.driver import with_

from .base import query

QUERY = "That it was this with for erhant"
SHORT = "that it."
AS_OF = dims.AS_OF
_SPLIT = r"'[^\p{L}\p{N}]+'"
_FIELDS = ("title", "summary", "body", "array_to_string(tags, ' ')")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def terms(c: str, least: int) -> str:
    return f"list_filter(string_split_regex(lower({c}), {_SPLIT}), lambda t: length(t) >= {least})"


def term_set(c: str, least: int = 3) -> str:
    return f"list_distinct({terms(c, least)})"


def index_tokens(*cols: str) -> str:
    return " || ".join(f"list_filter(string_split_regex(strip_accents(lower(coalesce({c}, ''))), {_SPLIT}), lambda t: t <> '')" for c in cols)


def support(c: str) -> str:
    stem = "CASE WHEN strlen(t) > 5 AND ends_with(t, 'ies') THEN left(t, length(t) - 3) || 'y'" + "".join(
        f" WHEN strlen(t) > {len(e) + 3} AND ends_with(t, '{e}') THEN left(t, length(t) - {len(e)})" for e in ("ing", "ed", "es", "s")
    )
    return f"list_distinct(list_transform(list_filter({terms(c, 3)}, lambda t: NOT list_contains({sql_list(dims.SUPPORT_STOPWORDS)}, t)), lambda t: {stem} ELSE t END))"


def bm25(source: str, key: str, q: str, *cols: str) -> str:
    """Subqueries tok, n, df, hits (key, bm25) over a subquery."""
    words = search.query_terms(q)
    return f""", tok AS (SELECT {key}, {index_tokens(*cols)} AS tokens FROM {source}), stat AS (SELECT count(*) AS n, avg(len(tokens)) AS average FROM tok),
qt AS (SELECT unnest({sql_list(words)}) AS term), tf AS (SELECT {key}, len(tokens) AS dl, term, (SELECT count(*) FROM (SELECT unnest(tokens) AS u) WHERE u = term) AS tf FROM tok, (SELECT DISTINCT term FROM qt)),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
hits AS (SELECT {key}, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))) AS bm25 FROM qt JOIN tf USING (term) JOIN df USING (term), stat WHERE tf > 0 GROUP BY {key})"""


@query("A1_match_terms", f"SELECT doc_id, list_filter({terms('text', 2)}, lambda t: NOT list_contains({sql_list(dims.SEARCH_STOPWORDS)}, t)) AS terms FROM documents")
def a1(t):
    return t.documents.select("doc_id", text.match_terms(F.col("text")).alias("terms"))


@query("A2_exact_lane", with_("memories") + "SELECT id, 1.0::DOUBLE AS relevance FROM x_memories WHERE lower(trim(title)) = 'that it.' AND status <> 'expired' ORDER BY updated_at DESC, id LIMIT 8")
def a2(t):
    return search.exact(t.memories.where(search.visible(None)), SHORT, 8).select("id", "relevance")


def _memories(t):
    return t.index("memories", search.FIELDS, "status <> 'expired'")


def _passages(t):
    return t.index("chunks", ("body",))


_RANKED = (
    bm25("(SELECT * FROM x_memories WHERE status <> 'expired')", "id", "{q}", *_FIELDS)
    + """, top AS (SELECT id, bm25, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) - 1 AS position FROM hits JOIN x_memories USING (id) WHERE {where} ORDER BY position LIMIT 40),
rel AS (SELECT id, greatest(0, least(1, 0.65 * bm25 / max(bm25) OVER () + 0.35 / (1 + 0.12 * position))) AS relevance, 1 AS lane, position FROM top)"""
)


def _ranked(q: str, where: str = "true") -> str:
    return bm25("(SELECT * FROM x_memories WHERE status <> 'expired')", "id", q, *_FIELDS) + _RANKED[_RANKED.index(", top AS") :].replace("{where}", where)


@query("A3_bm25_lane", with_("memories") + _ranked(QUERY, "domain = 'work'") + "SELECT id, round(relevance, 6) AS relevance, position FROM rel")
def a3(t):
    return search.ranked(t.memories, QUERY, "work", True, 40, _memories(t)).select("id", F.round("relevance", 6).alias("relevance"), F.col("position").cast("bigint").alias("position"))


@query("A3_tag_lane", with_("memories") + _ranked("shelf 13", "true") + "SELECT id, round(relevance, 6) AS relevance, position FROM rel")
def a3_tags(t):
    """Words that memories hold in their tags only."""
    return search.ranked(t.memories, "shelf 13", None, True, 40, _memories(t)).select("id", F.round("relevance", 6).alias("relevance"), F.col("position").cast("bigint").alias("position"))


def many(source: str, key: str, *cols: str) -> str:
    """Subqueries ask (q, query, domain) to hits (q, key, bm25) over a subquery, for the items of ``benchmark`` as questions."""
    return f""", ask AS (SELECT item_id AS q, left(text, 1000) AS query, {_DOMAIN} AS domain FROM benchmark), qt AS (SELECT q, term, count(*) AS times FROM
 (SELECT q, strip_accents(unnest(list_filter({terms("query", 2)}, lambda t: NOT list_contains({sql_list(dims.SEARCH_STOPWORDS)}, t)))) AS term FROM ask) GROUP BY ALL),
tok AS (SELECT {key}, {index_tokens(*cols)} AS tokens FROM {source}), stat AS (SELECT count(*) AS n, avg(len(tokens)) AS average FROM tok),
tf AS (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hits AS (SELECT q, {key}, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))) AS bm25 FROM qt JOIN tf USING (term) JOIN df USING (term), stat GROUP BY q, {key})"""


_DOMAIN = f"CASE WHEN item_id % 2 = 0 THEN {sql_list(dims.DOMAINS)}[(item_id % 6 + 1)::INT] END"
_LIVE = "(SELECT * FROM x_memories WHERE status <> 'expired')"


def _questions(t):
    """The items of ``benchmark`` as questions, every second one in one domain only."""
    domain = F.when(F.col("item_id") % 2 == 0, F.element_at(F.array(*map(F.lit, dims.DOMAINS)), (F.col("item_id") % 6 + 1).cast("int")))
    return t.benchmark.select(F.col("item_id").alias("q"), F.left("text", F.lit(1000)).alias("query"), domain.alias("domain"))


_MANY_RANKED = many(_LIVE, "id", *_FIELDS) + """, top AS (SELECT q, id, bm25, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, doc_id) - 1 AS position FROM hits JOIN x_memories USING (id) JOIN ask USING (q)
 WHERE ask.domain IS NULL OR ask.domain = x_memories.domain QUALIFY position < 40)"""


@query("A3_questions", with_("memories") + _MANY_RANKED + " SELECT q, id, position, round(bm25, 6) AS bm25 FROM top")
def a3_questions(t):
    """The ranked lane of all questions in one job."""
    asked = search.question_terms(_questions(t), "q", "query", "domain")
    found = _memories(t).best(asked, t.memories.where(search.visible(None)), 40, tie="doc_id")
    return found.select("q", "id", F.col("position").cast("bigint").alias("position"), F.round("bm25", 6).alias("bm25"))


@query(
    "A8_questions",
    with_("chunks", "imports")
    + many("x_chunks", "id", "body")
    + f""", pool AS (SELECT q, id, import_id, body, query, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, id) - 1 AS position FROM hits JOIN x_chunks USING (id) JOIN ask USING (q)
 WHERE (ask.domain IS NULL OR ask.domain = x_chunks.domain) AND import_id IN (SELECT id FROM x_imports WHERE extraction_quality_status <> 'failed') QUALIFY position < 32),
s AS (SELECT *, greatest(0, least(1, 0.72 * coalesce(len(list_intersect({term_set("query")}, {term_set("body")})) / nullif(len({term_set("query")}), 0), 0) + 0.28 / (1 + 0.18 * position))) AS score FROM pool)
SELECT q, id, import_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, position) AS rank FROM s QUALIFY rank <= 8""",
)
def a8_questions(t):
    """Passages for all questions in one job."""
    found = search.passage_questions(t.chunks, t.imports, _questions(t), _passages(t))
    return found.select("q", F.col("rank").cast("bigint").alias("rank"), "id", "import_id", F.round("score", 6).alias("score"))


_AFTER = """, x_after AS (SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN 'erhant for ' || doc_id ELSE title END AS title, CASE WHEN doc_id % 4 = 0 THEN ['moved'] ELSE tags END AS tags) FROM x_memories WHERE status <> 'expired' AND doc_id % 10 <> 3)"""


@query(
    "S18_index_followed",
    with_("memories")
    + _AFTER
    + bm25("x_after", "id", QUERY + " moved", *_FIELDS)
    + " SELECT id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) - 1 AS position FROM hits JOIN x_after USING (id) QUALIFY position < 40",
)
def s18_index(t):
    """A search after memories came, changed and went: the index has followed by segments of what changed."""
    from noctua.operators.index import Index

    live = t.memories.where("status <> 'expired'")
    index = Index.build(live.where("doc_id % 9 <> 4"), t.scratch("followed"), search.FIELDS).changed(live.where("doc_id % 9 = 4"))
    new = live.where("doc_id % 4 = 0 AND doc_id % 10 <> 3").withColumns({"title": F.concat(F.lit("erhant for "), F.col("doc_id").cast("string")), "tags": F.array(F.lit("moved"))})
    index = index.changed(new, live.where("doc_id % 10 = 3").select("id"))
    words = search.query_terms(QUERY + " moved")
    asked = t.spark.createDataFrame([(0, w) for w in words], "q int, term string")
    found = index.best(asked, live.where("doc_id % 10 <> 3"), 40, tie="doc_id", own=sorted(set(words)))
    return found.select("id", F.round("bm25", 6).alias("bm25"), F.col("position").cast("bigint").alias("position"))


_HALF = "CASE mem_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.HALF_LIFE.items()) + " ELSE 180 END"
_AGE = f"CASE WHEN contains(updated_at, 'T') THEN trunc(epoch(TIMESTAMP '{AS_OF}' - replace(replace(updated_at, 'T', ' '), 'Z', '')::TIMESTAMP) / 86400)::BIGINT ELSE date_diff('day', updated_at::DATE, DATE '{AS_OF}') END"
_RECENCY, _TRUST = f"exp(-ln(2) * age / {_HALF})", "confidence * least(1, 0.6 + 0.1 * confirmation_count)"


@query("A4_composite_score", with_("memories") + f"SELECT id, round(greatest(0, 0.6 * 0.5 + 0.25 * {_RECENCY} + 0.15 * {_TRUST} - CASE WHEN status = 'stale' THEN 0.3 ELSE 0 END), 6) AS score FROM (SELECT *, {_AGE} AS age FROM x_memories)")
def a4(t):
    return t.memories.withColumn("relevance", F.lit(0.5)).select("id", F.round(search.composite(AS_OF), 6).alias("score"))


@query("A5_age_days", with_("memories") + f"SELECT id, {_AGE} AS age FROM x_memories")
def a5(t):
    return t.memories.select("id", search.age_days(F.col("updated_at"), AS_OF).alias("age"))


_SEARCH = f""", lanes AS (SELECT * FROM rel UNION ALL SELECT * FROM (SELECT id, 1.0, 0, row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS p FROM x_memories WHERE lower(trim(title)) = 'that it.' AND status <> 'expired' ORDER BY p LIMIT 8)),
best AS (SELECT id, lane, position, relevance FROM lanes QUALIFY row_number() OVER (PARTITION BY id ORDER BY lane, position) = 1),
scored AS (SELECT *, greatest(0, 0.6 * relevance + 0.25 * {_RECENCY} + 0.15 * {_TRUST} - CASE WHEN status = 'stale' THEN 0.3 ELSE 0 END) AS score FROM (SELECT *, {_AGE} AS age FROM x_memories) JOIN best USING (id)),
found AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, lane, position) AS rank FROM scored ORDER BY rank LIMIT 8)"""


@query("A6_search", with_("memories") + _ranked(SHORT) + _SEARCH + " SELECT rank::BIGINT AS rank, id, round(score, 6) AS score, round(relevance, 6) AS relevance FROM found")
def a6(t):
    return search.search(t.memories, SHORT, AS_OF, index=_memories(t)).select(F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


_ESC = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_HEAD = """'<memory source="' || vault_path || '" status="' || status || '"' || CASE WHEN status = 'stale' THEN ' verify="UNVERIFIED"' ELSE '' END"""


@query(
    "A7_context",
    with_("memories")
    + _ranked(SHORT)
    + _SEARCH
    + f""", entry AS (SELECT row_number() OVER (ORDER BY rank) AS k, vault_path, status = 'stale' AS stale, {_HEAD} || ' confirmed="' || coalesce(last_confirmed_at, 'never') || '">' || chr(10) || {_ESC.format(c="body")} || chr(10) || '</memory>' || chr(10) AS whole,
{_HEAD} || ' compressed="true">' || {_ESC.format(c="summary")} || ' </memory>' || chr(10) AS short FROM found WHERE sensitivity <> 'sensitive'),
fold AS (SELECT 0::BIGINT AS k, '' AS block, 0::BIGINT AS used, []::VARCHAR[] AS injected, []::VARCHAR[] AS unverified
UNION ALL SELECT k2, CASE WHEN x IS NULL THEN block ELSE block || x END, CASE WHEN x IS NULL THEN used ELSE used + strlen(x) END, CASE WHEN x IS NULL THEN injected ELSE list_append(injected, path) END, CASE WHEN x IS NULL OR NOT stale THEN unverified ELSE list_append(unverified, path) END
FROM (SELECT f.*, e.vault_path AS path, e.stale AS stale, e.k AS k2, CASE WHEN used + strlen(whole) <= 16000 THEN whole WHEN used + strlen(short) <= 16000 THEN short END AS x FROM fold f JOIN entry e ON e.k = f.k + 1))
SELECT block, used, injected, unverified FROM fold ORDER BY k DESC LIMIT 1""",
)
def a7(t):
    return search.context(search.search(t.memories, SHORT, AS_OF, index=_memories(t))).withColumn("used", F.col("used").cast("bigint"))


_ASKED = sql_list(sorted({w for w in QUERY.lower().split() if len(w) > 2}))


@query(
    "A8_passages",
    with_("chunks", "imports")
    + bm25("x_chunks", "id", QUERY, "body")
    + f""", pool AS (SELECT id, import_id, body, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) - 1 AS position FROM hits JOIN x_chunks USING (id) WHERE domain = 'work' AND import_id IN (SELECT id FROM x_imports WHERE extraction_quality_status <> 'failed') ORDER BY position LIMIT 32),
s AS (SELECT *, greatest(0, least(1, 0.72 * len(list_intersect({_ASKED}, {term_set("body")})) / len({_ASKED}) + 0.28 / (1 + 0.18 * position))) AS score FROM pool) SELECT id, import_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, position LIMIT 8""",
)
def a8(t):
    return search.passages(t.chunks, t.imports, QUERY, "work", index=_passages(t)).select("id", "import_id", F.round("score", 6).alias("score"))


_TRIM = r"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"


@query(
    "A9_excerpt",
    f"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '[\\n.!?]'), lambda x: {_TRIM.format(c="x")}), lambda x: x <> '') AS parts FROM documents),
s AS (SELECT doc_id, text, list_max(list_transform(parts, lambda x, i: {{'n': len(list_intersect({term_set("x")}, {_ASKED})), 'i': i, 'x': x}})) AS best FROM p) SELECT doc_id, left(coalesce(best.x, {_TRIM.format(c="text")}), 420) AS excerpt FROM s""",
)
def a9(t):
    return t.documents.select("doc_id", search.excerpt(F.col("text"), F.lit(QUERY)).alias("excerpt"))


@query("A10_fused_evidence")
def a10(t):
    """Evidence of each import: the best memories and passages of whole documents, nearly equal ones of a path dropped."""
    number, length = F.expr("doc_id % 300").alias("import_id"), lambda c: (F.length(c) / 2000).alias("score")
    memories = t.memories.select(number, F.concat(F.lit("memory:"), "id").alias("id"), F.col("doc_id").alias("nr"), length("body"), F.col("vault_path").alias("path"), F.col("body").alias("text"))
    chunks = documents.chunked(t.documents.select("doc_id", "text"))
    name = F.concat_ws(":", F.lit("source"), F.expr("doc_id % 300").cast("string"), F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id")
    path = F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("path")
    passages = chunks.select(number, name, F.col("doc_id").alias("nr"), length("chunk"), path, F.col("chunk").alias("text"))
    return search.fused_evidence(memories, passages, "import_id")


def _second_half():
    return F.expr("substring(text, cast(length(text) div 2 as int) + 1)")


def _claims(t):
    d = t.documents
    # the first twelve words, cut before a row becomes three; the rest is not split
    words = F.filter(F.slice(F.split(F.regexp_replace("text", r"\A[ \n\t\r]+", ""), r"[ \n\t\r]+", 13), 1, 12), lambda x: x != "")
    no = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("claim_no")
    return d.select("doc_id", words.alias("w")).select("doc_id", "w", no).select(
        F.col("doc_id").alias("question_id"), "claim_no",
        F.concat(F.array_join(F.slice("w", F.col("claim_no") * 4 - 3, 4), " "), F.when(F.col("claim_no") == 3, F.lit(" nowhere")).otherwise("")).alias("text"),
        F.array(F.lit(1), F.col("claim_no"), F.lit(9)).alias("citations"),
    )


def _evidence(t):
    return t.documents.select(F.col("doc_id").alias("question_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("number"), "text").select(
        "question_id", "number", F.concat(F.lit("p"), F.col("number").cast("string")).alias("path"), F.when(F.col("number") == 1, F.col("text")).otherwise(_second_half()).alias("text"), (1.0 - 0.1 * F.col("number")).alias("score")
    )


_CLAIMS = f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\n\\t\\r]+') AS w FROM documents),
c AS (SELECT doc_id AS question_id, n AS claim_no, trim(array_to_string(w[n * 4 - 3:n * 4], ' ') || CASE WHEN n = 3 THEN ' nowhere' ELSE '' END) AS text, list_distinct(list_filter([1, n], lambda x: x <= 2)) AS cites FROM d, (SELECT unnest([1, 2, 3]) AS n)),
e AS (SELECT doc_id AS question_id, n AS number, 'p' || n AS path, CASE WHEN n = 1 THEN text ELSE substr(text, length(text) // 2 + 1) END AS text, 1.0 - 0.1 * n AS score FROM d, (SELECT unnest([1, 2]) AS n)),
ev AS (SELECT c.question_id, c.claim_no, c.text, list_sort(list(number)) AS citations, flatten(list({support("e.text")})) AS terms FROM c JOIN e ON e.question_id = c.question_id AND list_contains(c.cites, e.number) WHERE c.text <> '' AND length(c.text) <= 600 GROUP BY ALL),
ok AS (SELECT question_id, claim_no, text, citations FROM ev WHERE len({support("text")}) > 0 AND len(list_filter({support("text")}, lambda t: NOT list_contains(terms, t))) = 0)"""


@query("B1_json_object", "SELECT conv_id, turn, nullif(regexp_extract('so: ' || CASE WHEN turn % 2 = 0 THEN '{\"a\": ' || turn || '}' ELSE '' END || ' done', '(?s)\\{.*\\}'), '') AS found FROM conversations")
def b1(t):
    said = F.concat(F.lit("so: "), F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"a": '), F.col("turn").cast("string"), F.lit("}"))).otherwise(""), F.lit(" done"))
    return t.conversations.select("conv_id", "turn", verify.json_object(said).alias("found"))


@query("B2_accepted_claims", _CLAIMS + " SELECT question_id, claim_no, text, citations FROM ok")
def b2(t):
    return verify.accepted(_claims(t), _evidence(t))


@query("B3_support_test", f"WITH s AS (SELECT doc_id, {support('c')} AS own, {support('text')} AS other FROM (SELECT doc_id, text, substr(text, length(text) // 2 + 1) || CASE WHEN doc_id % 2 = 0 THEN ' nowhere' ELSE '' END AS c FROM documents)) SELECT doc_id, len(own) > 0 AND len(list_filter(own, lambda t: NOT list_contains(other, t))) = 0 AS supported FROM s")
def b3(t):
    return t.documents.select("doc_id", verify.supported(F.concat(_second_half(), F.when(F.col("doc_id") % 2 == 0, " nowhere").otherwise("")), F.col("text")).alias("supported"))


@query("B4_support_terms", f"SELECT item_id, list_sort({support('text')}) AS terms FROM benchmark")
def b4(t):
    return t.benchmark.select("item_id", F.array_sort(text.support_terms(F.col("text"))).alias("terms"))


_NEW = ", r AS (SELECT question_id, claim_no, text, dense_rank() OVER (PARTITION BY question_id ORDER BY number) AS new FROM (SELECT question_id, claim_no, text, unnest(citations) AS number FROM ok)), marks AS (SELECT question_id, claim_no, text, string_agg('[' || new || ']', '' ORDER BY new) AS marks FROM r GROUP BY ALL)"


@query("B5_renumbered", _CLAIMS + _NEW + " SELECT * FROM marks")
def b5(t):
    return verify.renumbered(verify.accepted(_claims(t), _evidence(t)))


@query(
    "B6_answers",
    _CLAIMS
    + _NEW
    + """, said AS (SELECT question_id, string_agg(regexp_replace(text, '[. ]+$', '') || ' ' || marks, '. ' ORDER BY claim_no) || '.' AS answer FROM marks GROUP BY 1),
f AS (SELECT question_id, avg(score) AS a, count(DISTINCT path) AS sources FROM (SELECT DISTINCT question_id, unnest(citations) AS number FROM ok) JOIN e USING (question_id, number) GROUP BY 1), g AS (SELECT *, greatest(0, least(1, 0.82 * a + 0.18 * least(sources, 3) / 3)) AS s FROM f)
SELECT question_id, answer, sources, round(s, 6) AS score, CASE WHEN s >= 0.78 AND sources >= 2 THEN 'high' WHEN s >= 0.55 THEN 'medium' ELSE 'low' END AS confidence FROM said JOIN g USING (question_id)""",
)
def b6(t):
    e = _evidence(t)
    return verify.answers(verify.accepted(_claims(t), e), e)


@query("G17_term_frequencies", with_("memories") + f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest({index_tokens(*_FIELDS)}) AS term FROM x_memories) GROUP BY term")
def g17(t):
    return search.corpus_stats(t.memories)


@query("G18_citation_figures", _CLAIMS + " SELECT question_id, round(avg(score), 6) AS average, count(DISTINCT path) AS sources FROM (SELECT DISTINCT question_id, unnest(citations) AS number FROM ok) JOIN e USING (question_id, number) GROUP BY 1")
def g18(t):
    used = verify.accepted(_claims(t), _evidence(t)).select("question_id", F.explode("citations").alias("number")).distinct().join(_evidence(t), ["question_id", "number"])
    return used.groupBy("question_id").agg(F.round(F.avg("score"), 6).alias("average"), F.count_distinct("path").alias("sources"))


@query("J1_hits_with_memories", with_("memories") + bm25("(SELECT * FROM x_memories WHERE status <> 'expired')", "id", SHORT, *_FIELDS) + " SELECT id, title, domain, round(bm25, 6) AS bm25 FROM hits JOIN x_memories USING (id)")
def j1(t):
    return search.bm25(t.memories.where("status <> 'expired'"), search.query_terms(SHORT), index=_memories(t)).select("id", "title", "domain", F.round("bm25", 6).alias("bm25"))


@query("J2_hits_chunks_imports", with_("chunks", "imports") + bm25("x_chunks", "id", SHORT, "body") + " SELECT id, import_id, source_url, round(bm25, 6) AS bm25 FROM hits JOIN x_chunks USING (id) JOIN (SELECT id AS import_id, source_url FROM x_imports) USING (import_id)")
def j2(t):
    hits = search.bm25(t.chunks, search.query_terms(SHORT), ("body",), _passages(t))
    return hits.join(t.imports.select(F.col("id").alias("import_id"), "source_url"), "import_id").select("id", "import_id", "source_url", F.round("bm25", 6).alias("bm25"))


@query("J11_cited_evidence", _CLAIMS + " SELECT question_id, claim_no, number, path, score::DOUBLE AS score FROM (SELECT question_id, claim_no, unnest(cites) AS number FROM c) JOIN e USING (question_id, number)")
def j11(t):
    cited = _claims(t).select("question_id", "claim_no", F.explode(F.array_distinct("citations")).alias("number"))
    return cited.join(_evidence(t), ["question_id", "number"]).select("question_id", "claim_no", "number", "path", "score")

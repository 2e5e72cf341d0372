"""Registered queries of the catalog, of sources and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctua.functions import dims, text
from noctua.operators import catalog, documents
from noctua.sources import tables, vault
from noctua.sources.driver import with_

from .base import query
from .retrieval import sql_list

_WORDS = ("n8n-nodes-base start", "@modelcontextprotocol/sdk mcp", "prompt templates", "langgraph dag", "openai gpt agent", "playwright scrape", "claude anthropic", "gemini pipeline", "lodash left-pad", "crewai crew")


def _manifests(t):
    k = F.col("p_partkey")
    words = F.element_at(F.array(*map(F.lit, _WORDS)), (k % 10 + 1).cast("int"))
    return t.part.select(k.alias("id"), F.concat(words, F.lit(" "), F.lower("p_name")).alias("words"), (k % 7 == 0).alias("has_crewai"))


_MAN = f"WITH m AS (SELECT p_partkey AS id, {sql_list(_WORDS)}[(p_partkey % 10)::INT + 1] || ' ' || lower(p_name) AS words, p_partkey % 7 = 0 AS has_crewai FROM part)"


def _signals(pairs, c: str = "words") -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in pairs)


@query("K1_united_detectors", with_("catalog") + "SELECT kind, provider, count(*) AS items FROM (SELECT kind, provider FROM x_catalog UNION ALL SELECT 'plugin', 'local' FROM part WHERE p_size < 5) GROUP BY ALL")
def k1(t):
    plugins = t.part.where("p_size < 5").select(F.lit("plugin").alias("kind"), F.lit("local").alias("provider"))
    return t.catalog.select("kind", "provider").unionByName(plugins).groupBy("kind", "provider").agg(F.count("*").alias("items"))


_PY = [s for s in dims.KIND_SIGNALS if s[1][0] in ("workflow", "agent", "automation")]


@query("K2_manifest_kinds", _MAN + f" SELECT id, {_signals(dims.KIND_SIGNALS)} END AS kind, CASE WHEN has_crewai THEN 'agent' ELSE {_signals(_PY)} END END AS python_kind, contains(words, 'mcp') OR contains(words, 'modelcontextprotocol') AS mcp FROM m")
def k2(t):
    w = F.col("words")
    return _manifests(t).select("id", catalog.manifest_kind(w).alias("kind"), catalog.python_kind(w, F.col("has_crewai")).alias("python_kind"), catalog.is_mcp(w).alias("mcp"))


@query("K3_providers", _MAN + f" SELECT id, p AS provider, CASE WHEN p = 'local' THEN 'claude' ELSE p END AS preferred FROM (SELECT id, {_signals(dims.PROVIDER_SIGNALS)} ELSE 'local' END AS p FROM m)")
def k3(t):
    p = catalog.provider(F.col("words"))
    return _manifests(t).select("id", p.alias("provider"), catalog.preferred_provider(p, F.lit("claude")).alias("preferred"))


_KR = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.KIND_RANK.items()) + " END"
_AHEAD = f"(b.confidence > a.confidence OR (b.confidence = a.confidence AND {_KR.format(c='b.kind')} < {_KR.format(c='a.kind')}))"


def _rich(c: str) -> str:
    lead, rest = f"(CASE WHEN {_AHEAD} THEN b.{c} ELSE a.{c} END)", f"(CASE WHEN {_AHEAD} THEN a.{c} ELSE b.{c} END)"
    return f"CASE WHEN {lead} IS NULL THEN {rest} WHEN {rest} IS NOT NULL AND strlen({rest}) > strlen({lead}) THEN {rest} ELSE {lead} END"


def _lead(c: str) -> str:
    return f"CASE WHEN {_AHEAD} THEN b.{c} ELSE a.{c} END"


_ALL_TAGS = f"CASE WHEN {_AHEAD} THEN b.tags || a.tags ELSE a.tags || b.tags END"
_MERGE = with_("catalog") + f""", n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM x_catalog),
fold AS (SELECT id, n, kind, display_name, summary, category, provider, tags, updated_at, confidence FROM n WHERE n = 1 UNION ALL
SELECT a.id, b.n, {_lead("kind")}, {_lead("display_name")}, {_rich("summary")}, {_rich("category")}, CASE WHEN {_lead("provider")} = 'local' AND (CASE WHEN {_AHEAD} THEN a.provider ELSE b.provider END) <> 'local' THEN (CASE WHEN {_AHEAD} THEN a.provider ELSE b.provider END) ELSE {_lead("provider")} END,
list_reduce({_ALL_TAGS}, lambda x, y: CASE WHEN list_contains(list_transform(x, lambda z: lower(z)), lower(y)) THEN x ELSE list_append(x, y) END, []::VARCHAR[]),
CASE WHEN a.updated_at IS NULL THEN b.updated_at WHEN b.updated_at IS NULL THEN a.updated_at ELSE greatest(a.updated_at, b.updated_at) END, greatest(a.confidence, b.confidence) FROM fold a JOIN n b ON b.id = a.id AND b.n = a.n + 1),
m AS (SELECT * EXCLUDE n FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)"""


@query("K4_merged_items", _MERGE + " SELECT id, kind, display_name, summary, category, provider, tags, updated_at, confidence FROM m")
def k4(t):
    items = t.catalog.select("id", "ord", "kind", "display_name", "summary", "category", "provider", "tags", "updated_at", "confidence")
    return catalog.merged(items)


@query("G19_merged_by_provider", _MERGE + " SELECT provider, count(*) AS items FROM m GROUP BY provider")
def g19(t):
    items = t.catalog.select("id", "ord", "kind", "display_name", "summary", "category", "provider", "tags", "updated_at", "confidence")
    return catalog.merged(items).groupBy("provider").agg(F.count("*").alias("items"))


@query("G11_kind_counts", with_("catalog") + "SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in dims.KINDS) + " FROM x_catalog")
def g11(t):
    return catalog.counts(t.catalog)


@query("O2_catalog_order", with_("catalog") + f"SELECT ord, kind FROM x_catalog ORDER BY {_KR.format(c='kind')}, display_name, id, ord")
def o2(t):
    return t.catalog.orderBy(catalog.kind_rank(F.col("kind")), "display_name", "id", "ord").select("ord", "kind")


@query("O7_last_of_best", with_("catalog") + "SELECT id, max_by(ord, (confidence, ord)) AS ord FROM x_catalog GROUP BY id")
def o7(t):
    return t.catalog.groupBy("id").agg(F.max_by("ord", F.struct("confidence", "ord")).alias("ord"))


@query("O6_stable_ties", with_("catalog") + "SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, ord) AS place FROM x_catalog")
def o6(t):
    from pyspark.sql import Window

    return t.catalog.select("id", "ord", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "ord")).cast("bigint").alias("place"))


@query("O5_claim_order", "SELECT doc_id, score, claim FROM (SELECT doc_id, doc_id % 5 AS score, text AS claim FROM documents) ORDER BY score DESC, claim, doc_id")
def o5(t):
    return t.documents.select("doc_id", (F.col("doc_id") % 5).alias("score"), F.col("text").alias("claim")).orderBy(F.desc("score"), "claim", "doc_id")


_FILES = ("agent.py", "readme.md", "SKILL.md", "run.sh", "workflow.yaml", "notes", ".env", "playwright.spec.ts", "x.prompt.txt")


def _paths(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), F.concat(F.lit("/home/u/ws/d"), (k % 50).cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, _FILES)), (k % 9 + 1).cast("int"))).alias("path"), F.element_at(F.array(*map(F.lit, dims.KINDS)), (k % 8 + 1).cast("int")).alias("kind"))


_PATHS = f"WITH f AS (SELECT p_partkey AS id, '/home/u/ws/d' || (p_partkey % 50) || '/' || {sql_list(_FILES)}[(p_partkey % 9)::INT + 1] AS path, {sql_list(dims.KINDS)}[(p_partkey % 8)::INT + 1] AS kind FROM part), e AS (SELECT *, nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1), '') AS ext FROM f)"


@query(
    "K6_supported_files",
    _PATHS + " SELECT id, coalesce(" + " OR ".join(f"(kind = '{k}' AND ext IN ({', '.join(repr(x) for x in v)}))" for k, v in dims.KIND_EXTENSIONS.items()) + " OR (kind = 'skill' AND ends_with(path, '/SKILL.md')), false) AS supported, "
    + f"coalesce(ext IN ({', '.join(repr(x) for x in dims.SCRIPT_EXTENSIONS)}), false) AND (" + " OR ".join(f"contains(lower(regexp_extract(path, '[^/]*$')), '{w}')" for w in dims.SCRIPT_NAMES) + ") AS script FROM e",
)
def k6(t):
    return _paths(t).select("id", catalog.supported_file(F.col("path"), F.col("kind")).alias("supported"), catalog.script_candidate(F.col("path")).alias("script"))


@query("K5_built_items", _PATHS + f" SELECT '~/' || substr(path, 9) || '::' || kind AS item_id, kind, {_signals(dims.PROVIDER_SIGNALS, 'lower(path)')} ELSE 'local' END AS provider, CASE WHEN ext IS NULL THEN [kind] ELSE [ext] END AS tags FROM e WHERE kind <> 'skill'")
def k5(t):
    """Items from files: id, provider by path, tags by extension."""
    f = _paths(t).where("kind <> 'skill'")
    ext = catalog.extension(F.col("path"))
    return f.select(catalog.item_id(F.col("path"), "/home/u", F.col("kind")).alias("item_id"), "kind", catalog.provider(F.col("path")).alias("provider"), F.when(ext.isNull(), F.array("kind")).otherwise(F.array(ext)).alias("tags"))


@query("K7_manifest_tags", _MAN + f" SELECT id, CASE WHEN len(t) = 0 THEN ['manifest'] ELSE t END AS tags FROM (SELECT id, list_filter({sql_list(dims.MANIFEST_TAGS)}, lambda k: contains(words, k)) AS t FROM m)")
def k7(t):
    return _manifests(t).select("id", catalog.manifest_tags(F.col("words")).alias("tags"))


@query("K7_relevant_scripts", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'build: run agent' WHEN 1 THEN 'dev: vite' END AS script FROM part")
def k7b(t):
    k = F.col("p_partkey") % 3
    scripts = F.when(k == 0, F.create_map(*map(F.lit, ("test", "jest", "build", "run agent", "dev", "vite")))).when(k == 1, F.create_map(*map(F.lit, ("test", "jest", "dev", "vite")))).otherwise(F.create_map(*map(F.lit, ("test", "jest"))))
    return t.part.select(F.col("p_partkey").alias("id"), catalog.relevant_script(scripts).alias("script"))


_CANDIDATES = ("/home/u/ws/a", "/home/u", "/home/u/a", "/home/u/.codex/x/y", "/home/u/x/App.app/z", "relative/x/y", "/home/u/.claude-notes/z")


@query("K8_workspaces", f"SELECT c_custkey AS id, {sql_list(_CANDIDATES)}[(c_custkey % 7)::INT + 1] AS path, [true, false, false, false, false, false, true][(c_custkey % 7)::INT + 1] AS ok FROM customer")
def k8(t):
    path = F.element_at(F.array(*map(F.lit, _CANDIDATES)), (F.col("c_custkey") % 7 + 1).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("id"), path.alias("path")).withColumn("ok", catalog.workspace(F.col("path"), "/home/u"))


@query("K9_workspace_roots", with_("threads") + "SELECT path FROM (SELECT '/home/u/ws/p' || n AS path, 0 AS lane, n::BIGINT AS ord FROM (SELECT unnest([3, 1]) AS n) UNION ALL SELECT cwd, 1, min(id) FROM x_threads GROUP BY cwd) GROUP BY path ORDER BY min((lane, ord)), path LIMIT 24")
def k9(t):
    first = t.spark.createDataFrame([("/home/u/ws/p3", 3), ("/home/u/ws/p1", 1), ("/home/u", 0)], "path string, ord bigint")
    return catalog.roots([first, t.threads.groupBy(F.col("cwd").alias("path")).agg(F.min("id").alias("ord"))], "/home/u")


def _tree(t):
    k = F.col("c_custkey")
    return t.customer.select(F.concat(F.lit("/r/"), (k % 90).cast("string"), F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit("/a")).otherwise(F.lit("/a/b"))).alias("path"))


_TREE = "WITH p AS (SELECT DISTINCT '/r/' || (c_custkey % 90) || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/a' ELSE '/a/b' END AS path FROM customer), top AS (SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.path <> p.path AND starts_with(p.path, q.path || '/')))"


@query("K10_topmost_roots", _TREE + " SELECT path FROM top")
def k10(t):
    return catalog.topmost(_tree(t))


@query("K10_instruction_items", _TREE + " SELECT path, 'AGENTS.md' AS entrypoint, 'longer text' AS summary, 'multi' AS provider FROM top")
def k10b(t):
    one = lambda name, summary: F.struct(F.lit(name).alias("name"), F.lit(summary).alias("summary"))
    names = F.explode(F.array(one("CLAUDE.md", "longer text"), one("AGENTS.md", "short"), one("other.md", "x" * 40))).alias("f")
    return catalog.instruction_items(_tree(t).distinct().select("path", names).select("path", "f.*"))


@query("K11_kind_constants", with_("catalog") + "SELECT ord, " + _KR.format(c="kind") + " AS rank, CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.KIND_CONFIDENCE.items()) + " END::DOUBLE AS confidence FROM x_catalog")
def k11(t):
    return t.catalog.select("ord", catalog.kind_rank(F.col("kind")).alias("rank"), catalog.kind_confidence(F.col("kind")).alias("confidence"))


def _folder_files(t):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("SKILL.md", "README.md", "main.py", "agent.ts"))), (k % 4 + 1).cast("int"))
    content = F.when(k % 4 == 0, F.concat(F.lit("---\nname: x\ndescription: \"Skill "), k.cast("string"), F.lit("\"\n---\n# T\nbody"))).when(k % 4 == 1, F.concat(F.lit("# Title\n\nReadme "), k.cast("string"))).otherwise(F.lit("import x\n# what this script does\n"))
    return t.part.select(k.alias("id"), F.concat(F.lit("/f/"), F.floor(k / 3).cast("string")).alias("folder"), name.alias("name"), content.alias("content"))


@query("K12_folder_summaries", "SELECT '/f/' || (p_partkey // 3) AS folder, arg_min(CASE WHEN p_partkey % 4 = 0 THEN 'Skill ' || p_partkey ELSE 'Readme ' || p_partkey END, CASE WHEN p_partkey % 4 = 1 THEN 0 ELSE 4 END) AS summary FROM part WHERE p_partkey % 4 < 2 GROUP BY 1")
def k12(t):
    return catalog.folder_summary(_folder_files(t))


@query("K12_folder_entrypoints", "SELECT '/f/' || (p_partkey // 3) AS folder, arg_min(['', 'README.md', 'main.py', 'agent.ts'][(p_partkey % 4)::INT + 1], [9, 10, 3, 1][(p_partkey % 4)::INT + 1]) AS entrypoint FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1")
def k12b(t):
    return catalog.folder_entrypoint(_folder_files(t))


@query("K13_mcp_servers", "SELECT 'c' || p_partkey AS path, 's' || i AS server, CASE WHEN i = 1 THEN 'https://x.y/' || p_partkey ELSE 'npx' END AS entrypoint, CASE WHEN i = 1 THEN 'local' ELSE 'local' END AS provider, 'MCP server endpoint: ' || CASE WHEN i = 1 THEN 'https://x.y/' || p_partkey ELSE 'npx' END AS summary, CASE WHEN i = 1 THEN ['mcp', 'http'] ELSE ['mcp'] END AS tags FROM part, (SELECT unnest([1, 2]) AS i)")
def k13(t):
    k = F.col("p_partkey").cast("string")
    content = F.concat(F.lit('{"mcpServers": {"s1": {"url": "https://x.y/'), k, F.lit('?token=1", "type": "http"}, "s2": {"command": "npx"}}}'))
    return catalog.mcp_servers(t.part.select(F.concat(F.lit("c"), k).alias("path"), content.alias("content")), "claude")


@query("K14_script_signals", _MAN + " SELECT id, contains(words, 'playwright') OR contains(words, 'puppeteer') OR contains(words, 'selenium') OR contains(words, 'tool_call') OR contains(words, 'tools=') AS signal FROM m")
def k14(t):
    return _manifests(t).select("id", catalog.script_signal(F.col("words")).alias("signal"))


@query("K15_path_helpers", _PATHS + " SELECT id, ext, len(list_filter(string_split(path, '/'), lambda p: p <> '')) AS depth, list_contains(string_split(path, '/'), 'd7') AS under FROM e")
def k15(t):
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    return _paths(t).select("id", catalog.extension(F.col("path")).alias("ext"), F.size(parts).cast("bigint").alias("depth"), F.array_contains(parts, "d7").alias("under"))


@query("S2_read_or_empty", "SELECT 0::BIGINT AS missing, count(*) AS present FROM events")
def s2(t):
    """A table that is missing reads as an empty one of the declared schema; one that is there reads as declared."""
    schema = "event_id bigint, event_type string"
    gone, here = (tables.read_or_empty(t.spark, f"{t.sf_dir}/{n}.parquet", schema) for n in ("threads_of_others", "events"))
    return gone.agg(F.count("*").alias("missing")).crossJoin(here.agg(F.count("*").alias("present")))


@query("S3_table_exists", "SELECT true AS documents, false AS nothing")
def s3(t):
    found = {n: tables.exists(t.spark, f"{t.sf_dir}/{n}.parquet") for n in ("documents", "nothing")}
    return t.spark.createDataFrame([(found["documents"], found["nothing"])], "documents boolean, nothing boolean")


def _notes(t):
    m = t.memories
    return m.select("id", "mem_type", "domain", F.concat(F.lit("T \"q\" "), "id").alias("title"), "created_at", "updated_at", "confidence", "sensitivity", F.array("lang", "source").alias("tags"), "stale_after_days", "expires_at", F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_until"), "body", "vault_path")


@query("S5_parsed_notes", with_("memories") + "SELECT id, vault_path AS path, mem_type, domain, 'T \"q\" ' || id AS title, updated_at, confidence, [lang, source] AS tags, stale_after_days, sha256(body) AS body_hash, NULL::VARCHAR AS error FROM x_memories")
def s5(t):
    """Notes rendered to files (S6) and parsed back."""
    files = _notes(t).select(F.col("vault_path").alias("path"), vault.rendered(_notes(t)).alias("content"))
    return vault.parsed(files).select("id", "path", "mem_type", "domain", "title", "updated_at", "confidence", "tags", "stale_after_days", F.sha2("body", 256).alias("body_hash"), "error")


@query("S6_rendered_notes", with_("memories") + """SELECT id, '---' || chr(10) || 'id: ' || id || chr(10) || 'type: ' || mem_type || chr(10) || 'domain: ' || domain || chr(10) || 'title: "T \\"q\\" ' || id || '"' || chr(10) || 'created: ' || created_at || chr(10) || 'updated: ' || updated_at || chr(10) || 'confidence: ' || confidence || chr(10) || 'sensitivity: ' || sensitivity || chr(10)
|| CASE WHEN stale_after_days IS NULL THEN '' ELSE 'stale_after_days: ' || stale_after_days || chr(10) END || CASE WHEN expires_at IS NULL THEN '' ELSE 'expires: ' || expires_at || chr(10) END || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10) || body AS file FROM x_memories""")
def s6(t):
    return _notes(t).select("id", vault.rendered(_notes(t)).alias("file"))


@query("S8_json_content", "SELECT doc_id, doc_id % 2 = 0 AS is_json, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS k FROM documents")
def s8(t):
    c = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"k": '), F.col("doc_id").cast("string"), F.lit("}"))).otherwise("{broken")
    rows = t.documents.select("doc_id", F.try_parse_json(c).alias("j"))
    return rows.select("doc_id", F.col("j").isNotNull().alias("is_json"), F.try_variant_get("j", "$.k", "bigint").alias("k"))


@query("S9_toml_values", "SELECT doc_id, 'p' || doc_id AS name, ['a', 'b' || doc_id] AS deps FROM documents")
def s9(t):
    i = F.col("doc_id").cast("string")
    c = F.concat(F.lit('[project]\nname = "p'), i, F.lit('"\ndependencies = [\n  "a",\n  "b'), i, F.lit('",\n]\n'))
    return t.documents.select("doc_id", tables.toml_string(c, "name").alias("name"), tables.toml_array(c, "dependencies").alias("deps"))


_DEEP = ("/w/a/x.md", "/w/a/node_modules/y.js", "/w/a/b/c/d/e/z.md", "/w/.git/config", "/w/dist/m.js", "/w/a/b/ok.py")


@query("S10_pruned_walk", f"SELECT c_custkey AS id, {sql_list(_DEEP)}[(c_custkey % 6)::INT + 1] AS path FROM customer WHERE c_custkey % 6 IN (0, 5)")
def s10(t):
    path = F.element_at(F.array(*map(F.lit, _DEEP)), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = t.customer.select(F.col("c_custkey").alias("id"), path.alias("path"))
    return rows.where(~tables.noisy(F.col("path"), dims.NOISE_DIRS) & tables.shallow(F.col("path"), 1, 5))


@query("S11_import_sources", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'url' ELSE 'text' END AS input_kind, length(CASE WHEN page_id % 2 = 0 THEN " + __import__("noctua.plans.documents", fromlist=["_HTML"])._HTML.format(c="html") + " ELSE html END) AS n FROM pages")
def s11(t):
    """Imports of several kinds: HTML is turned to text for extraction, other text is taken as it is."""
    kind = F.when(F.col("page_id") % 2 == 0, "url").otherwise("text")
    return t.pages.select("page_id", kind.alias("input_kind"), F.length(F.when(kind == "url", text.html_to_text(F.col("html"))).otherwise(F.col("html"))).cast("bigint").alias("n"))


@query("S13_pdf_signature", "SELECT doc_id, doc_id % 3 = 0 AS is_pdf FROM documents")
def s13(t):
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7 ").otherwise("PK "), "text")
    return t.documents.select("doc_id", F.startswith(F.unbase64(F.base64(F.encode(raw, "UTF-8"))), F.encode(F.lit("%PDF-"), "UTF-8")).alias("is_pdf"))


@query("S15_json_lines", with_("agent_lines") + "SELECT count(*) AS lines, count(*) FILTER (line NOT LIKE '{%') AS raw FROM x_agent_lines")
def s15(t):
    return t.agent_lines.agg(F.count("*").alias("lines"), F.count_if(F.try_parse_json("line").isNull()).alias("raw"))


@query("S16_source_snapshots", with_("imports") + "SELECT id, domain || '/sources/page-' || id || '-' || left(sha256(html), 8) || '.md' AS path, sha256(html) AS content_hash FROM x_imports")
def s16(t):
    rows = t.imports.select("id", "domain", F.concat(F.lit("Page "), F.col("id").cast("string")).alias("title"), F.col("html").alias("content"))
    return vault.source_snapshot(rows).select("id", "path", "content_hash")


@query("S21_updated_imports", with_("imports", "proposals") + "SELECT i.id, coalesce(n, 0) AS candidates, CASE WHEN coalesce(n, 0) = 0 THEN 'no_candidates' ELSE 'extracted' END AS status FROM x_imports i LEFT JOIN (SELECT import_id, count(*) AS n FROM x_proposals GROUP BY 1) ON import_id = i.id")
def s21(t):
    n = t.proposals.groupBy(F.col("import_id").alias("id")).agg(F.count("*").alias("n"))
    return t.imports.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("candidates"), F.when(F.coalesce("n", F.lit(0)) == 0, "no_candidates").otherwise("extracted").alias("status"))


@query("S22_index_rows", with_("memories") + "SELECT id, vault_path, left(body, 280) AS summary, sha256(body) AS content_hash FROM x_memories")
def s22(t):
    rows = t.memories.select("id", F.col("vault_path").alias("path"), "domain", "mem_type", "title", "body", "confidence", F.lit(None).cast("string").alias("error"))
    return vault.index_rows(rows).select("id", "vault_path", "summary", "content_hash")


@query("S23_evolved_schema", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM events")
def s23(t):
    e = t.events
    return tables.append(e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")), e.where("event_id % 2 = 1").select(F.col("event_id").alias("id"), "value"))


@query("P21_vault_tree", with_("memories") + "SELECT path, is_dir FROM (SELECT DISTINCT vault_path AS path, false AS is_dir FROM x_memories UNION SELECT DISTINCT domain || '/memories', true FROM x_memories UNION SELECT DISTINCT domain, true FROM x_memories) ORDER BY path")
def p21(t):
    return vault.tree(t.memories.select(F.col("vault_path").alias("path"))).select("path", "is_dir")


@query("P19_source_body", with_("imports") + "SELECT id, html AS body FROM x_imports")
def p19(t):
    rows = t.imports.select("id", "domain", F.lit("Page").alias("title"), F.col("html").alias("content"))
    return vault.source_snapshot(rows).select("id", vault.body_of(F.col("file")).alias("body"))


@query("P20_read_file", with_("memories") + "SELECT id, coalesce(CASE WHEN doc_id % 3 = 0 THEN status END, 'active') AS status, length(body) AS n FROM x_memories")
def p20(t):
    """A file's body with its status in the index; one that is not indexed is active."""
    m = t.memories
    return m.select("id", "body").join(m.where("doc_id % 3 = 0").select("id", "status"), "id", "left").select("id", F.coalesce("status", F.lit("active")).alias("status"), F.length("body").cast("bigint").alias("n"))


@query(
    "J12_near_duplicates",
    "WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 3))) AS w FROM documents), c AS (SELECT w, min(doc_id) AS class_id FROM d WHERE len(w) > 0 GROUP BY w), "
    "p AS (SELECT a.class_id AS x, b.class_id AS y FROM c a JOIN c b ON a.class_id < b.class_id AND least(len(a.w), len(b.w)) >= 0.72 * greatest(len(a.w), len(b.w)) AND len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) >= 0.72), "
    "n AS (SELECT x AS class_id, count(*) AS n_links FROM (SELECT x FROM p UNION ALL SELECT y FROM p) GROUP BY 1) SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN c USING (w) LEFT JOIN n USING (class_id)",
)
def j12(t):
    """Each document with the first one of the same words, and how many other sets of words are alike; whole texts, all ids."""
    classes, pairs = documents.near_duplicates(t.documents, 0.72)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return classes.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


@query("F11_stream_deduplicated", "SELECT event_type AS kind, count(*) AS events FROM events GROUP BY 1")
def f11s(t):
    """A stream over the event files, each event twice, run to its end: every number once."""
    from noctua.streaming import events as stream

    schema = t.events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    source = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet*")
    twice = source.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("at", F.col("ts").cast("timestamp"))
    once = stream.deduplicated(twice, ["event_id"], "at", "60 days")
    rows = stream.drained(once.select("event_id", F.col("event_type").alias("kind")), "F11_stream_deduplicated")
    return rows.groupBy("kind").agg(F.count("*").alias("events"))

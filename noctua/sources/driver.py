"""The driver's tables as the model's: memories, sources, threads, tasks, approvals, audit rows, agent events, catalog items.

Each function takes a ``Tables`` object. ``SQL`` holds the same derivations for DuckDB, as named subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctua.functions import dims
from noctua.operators.documents import chunked

_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def _pick(values, key: str):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.expr(key) + 1).cast("int"))


def _title(body: Column) -> Column:
    """The first eight words. Most texts have nine in their first 400 characters; of others the whole is looked at."""
    words = lambda c: F.split(F.ltrim(c, F.lit(" \n\t\r")), r"[ \n\t\r]+", 9)  # noqa: E731  the rest is not split
    head = words(F.left(body, F.lit(400)))
    return F.array_join(F.filter(F.slice(F.when(F.size(head) == 9, head).otherwise(words(body)), 1, 8), lambda x: x != ""), " ")


def memories(t) -> DataFrame:
    """One memory per document; two spellings of dates, all domains and types, some stale, expired or sensitive."""
    labels = t.spark.read.parquet(f"{t.sf_dir}/labels.parquet")
    # one row for each id: plans that use no label then do without the join
    d = t.documents.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    day = F.date_sub(F.lit(dims.AS_OF).cast("date"), F.expr("cast(doc_id % 400 as int)"))
    when = lambda c: F.when(F.col("doc_id") % 2 == 0, F.concat(c.cast("string"), F.lit("T08:30:00Z"))).otherwise(c.cast("string"))
    return d.select(
        "doc_id",
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(_pick(dims.DOMAINS, "cast(substr(source, 4) as int) % 6"), F.lit("/memories/m"), F.col("doc_id").cast("string"), F.lit(".md")).alias("vault_path"),
        _pick(dims.DOMAINS, "cast(substr(source, 4) as int) % 6").alias("domain"),
        _pick(dims.MEM_TYPES, "doc_id % 5").alias("mem_type"),
        _title(F.col("text")).alias("title"),
        F.left("text", F.lit(280)).alias("summary"),
        F.col("text").alias("body"),
        F.when(F.col("toxic") == 1, "sensitive").otherwise("normal").alias("sensitivity"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.4).otherwise(0.7).alias("confidence"),
        when(day).alias("updated_at"),
        when(F.date_sub(day, 30)).alias("created_at"),
        F.when(F.col("doc_id") % 3 == 0, when(F.date_sub(day, 10))).alias("last_confirmed_at"),
        F.when(F.expr("doc_id % 5 = 4"), F.date_add(day, 90).cast("string")).alias("expires_at"),
        F.when(F.expr("doc_id % 5 in (0, 2, 3)"), F.when(F.expr("doc_id % 5 = 0"), 180).otherwise(365)).cast("bigint").alias("stale_after_days"),
        (F.col("doc_id") % 6).alias("confirmation_count"),
        F.when(F.col("doc_id") % 7 == 0, "stale").when(F.col("doc_id") % 11 == 0, "expired").otherwise("active").alias("status"),
        F.array(F.concat(F.lit("shelf-"), (F.col("doc_id") % 97).cast("string")), F.concat(F.lit("lang "), "lang")).alias("tags"),
        "lang",
        "source",
    )


def threads(t) -> DataFrame:
    """Telemetry threads from events."""
    return t.events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("/home/u/ws/p"), (F.col("user_id") % 40).cast("string")).alias("cwd"),
        F.col("event_type").alias("title"),
        F.expr(f"{_MICROS} div 1000000").alias("updated_at"),
        F.when(F.col("event_id") % 3 != 0, F.expr(f"{_MICROS} div 1000")).alias("updated_at_ms"),
        F.floor(F.abs("value")).cast("bigint").alias("tokens_used"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("model"),
        (F.col("event_id") % 4 == 0).cast("int").alias("archived"),
    )


def tasks(t) -> DataFrame:
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Task "), F.col("o_orderkey").cast("string")).alias("title"),
        _pick(("push the release branch", "update notes for the team", "summarise open questions", "delete old invoices", "improve the docs", "list recent work"), "o_orderkey % 6").alias("goal"),
        F.lower("c_mktsegment").alias("domain"),
        _pick(dims.TASK_STATUSES, "o_orderkey % 12").alias("status"),
        _pick(("low", "medium", "high"), "o_orderkey % 3").alias("risk_level"),
        (F.col("o_orderkey") % 5000).alias("tokens"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("cost_usd"),
        F.col("o_orderdate").cast("date").alias("updated_on"),
    )


def approvals(t) -> DataFrame:
    return t.orders.select(
        (F.col("o_orderkey") * 10).alias("id"),
        F.col("o_orderkey").alias("task_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "pending").when(F.col("o_orderkey") % 3 == 1, "approved").otherwise("denied").alias("status"),
        F.col("o_orderdate").cast("date").alias("requested_on"),
    )


def imports(t) -> DataFrame:
    """One document import per page."""
    return t.pages.select(
        F.col("page_id").alias("id"),
        _pick(dims.DOMAINS, "page_id % 6").alias("domain"),
        F.col("url").alias("source_url"),
        F.col("html"),
        F.when(F.col("page_id") % 9 == 0, "failed").otherwise("passed").alias("extraction_quality_status"),
        F.date_sub(F.lit(dims.AS_OF).cast("date"), F.expr("cast(page_id % 90 as int)")).alias("created_on"),
    )


def proposals(t) -> DataFrame:
    """Proposals of imports: none for some, several for others."""
    n = F.expr("explode(sequence(0, cast(page_id % 4 as int)))").alias("k")
    p = t.pages.where("page_id % 7 <> 0").select("page_id", n)
    return p.select(
        (F.col("page_id") * 10 + F.col("k")).alias("id"),
        F.col("page_id").alias("import_id"),
        _pick(dims.DOMAINS, "page_id % 6").alias("domain"),
        F.when((F.col("page_id") + F.col("k")) % 3 == 0, "pending").when((F.col("page_id") + F.col("k")) % 3 == 1, "approved").otherwise("discarded").alias("status"),
        F.date_sub(F.lit(dims.AS_OF).cast("date"), F.expr("cast(page_id % 90 as int)")).alias("created_on"),
    )


def chunks(t) -> DataFrame:
    """Source passages: whole documents cut into passages (C7), each document as if of the import of the same number. They are cut once and stored."""
    return t.kept("chunks", lambda: _cut(t))


def chunked_imports(t) -> DataFrame:
    """(import_id) of the passages, repeats kept: a text that is not blank has one at least, so nothing is cut."""
    return t.documents.where(F.col("text").rlike(r"[^\s\x00]")).select(F.expr("doc_id % 300").alias("import_id"))


def _cut(t) -> DataFrame:
    cut = chunked(t.documents.select("doc_id", "source", "text"))
    return cut.select(
        (F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("id"), F.expr("doc_id % 300").alias("import_id"), _pick(dims.DOMAINS, "cast(substr(source, 4) as int) % 6").alias("domain"), F.col("chunk").alias("body")
    )


def audit(t) -> DataFrame:
    """Audit rows without hashes, from events: costs and tokens are null now and then."""
    return t.events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")).alias("task_id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("Z")).alias("ts"),
        _pick(("tool_call", "approval", "output", "model_call", "context"), "event_id % 5").alias("kind"),
        F.col("event_type").alias("summary"),
        F.col("props").alias("detail"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100).alias("tokens"),
    )


def agent_lines(t) -> DataFrame:
    """JSON lines of an agent process: one per conversation turn, in all shapes that the classifier knows, some not JSON."""
    text = F.col("text")
    item = lambda kind, field, value: F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit(kind).alias("type"), value.alias(field)).alias("item")))
    k = (F.col("conv_id") + F.col("turn")) % 9
    line = (
        F.when(k == 0, F.lit('{"type":"thread.started","thread_id":"th"}'))
        .when(k == 1, F.lit('{"type":"turn.started"}'))
        .when(k == 2, F.concat(F.lit('{"type":"turn.completed","usage":{"input_tokens":'), F.length(text).cast("string"), F.lit(',"output_tokens":'), (F.col("turn") * 7).cast("string"), F.lit("}}")))
        .when(k == 3, F.lit('{"type":"turn.failed","error":{"message":"it broke"}}'))
        .when(k == 4, item("agent_message", "text", text))
        .when(k == 5, item("command_execution", "command", F.left(text, F.lit(250))))
        .when(k == 6, F.lit('{"type":"token_count","total_tokens":41}'))
        .when(k == 7, F.lit('{"type":"exec.begin","command":"ls -la"}'))
        .otherwise(F.concat(F.lit("plain line "), F.col("turn").cast("string")))
    )
    return t.conversations.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), line.alias("line"))


def catalog(t) -> DataFrame:
    """Catalog items from parts: several detectors may report one id, in the order of ``ord``."""
    li = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size"), "l_partkey")
    return li.select(
        F.concat(F.lit("~/p/"), (F.col("l_partkey") % 500).cast("string")).alias("id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        _pick(dims.KINDS, "cast(l_quantity as int) % 8").alias("kind"),
        F.col("p_name").alias("display_name"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("p_type")).alias("summary"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).alias("category"),
        _pick(("local", "claude", "gemini", "local"), "l_orderkey % 4").alias("provider"),
        F.array(F.lower("p_brand"), F.element_at(F.split("p_type", " "), 1)).alias("tags"),
        F.when(F.col("l_linenumber") % 4 != 0, F.expr("datediff(l_shipdate, DATE'1970-01-01')").cast("bigint")).alias("updated_at"),
        _pick((0.72, 0.82, 0.82, 0.9), "l_linenumber % 4").alias("confidence"),
    )


def _case(values, key: str) -> str:
    return "([" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"])[({key})::INT + 1]"


_WHEN = "CASE WHEN doc_id % 2 = 0 THEN strftime({d}, '%Y-%m-%d') || 'T08:30:00Z' ELSE strftime({d}, '%Y-%m-%d') END"
_DAY = f"(DATE '{dims.AS_OF}' - (doc_id % 400)::INT)"

#: Passages (doc_id, chunk_index, chunk) of all documents.
CHUNKS = r"""WITH RECURSIVE d AS (SELECT doc_id, replace(replace(text, chr(0), ''), chr(13) || chr(10), chr(10)) AS s FROM documents),
step AS (SELECT doc_id, 0::BIGINT AS p0, s FROM d WHERE length(s) > 0 UNION ALL SELECT doc_id, stop - 220, s FROM (
  SELECT doc_id, p0, s, CASE WHEN p0 + 1500 < length(s) AND length(regexp_extract(substr(s, greatest(p0 + 1260, p0 + 1) + 1, 240), '(?s)^.*\s')) > 0 THEN p0 + 1260 + length(regexp_extract(substr(s, p0 + 1261, 240), '(?s)^.*\s')) ELSE least(p0 + 1500, length(s)) END AS stop FROM step) WHERE stop < length(s)),
cut AS (SELECT doc_id, p0, substr(s, p0 + 1, CASE WHEN p0 + 1500 < length(s) AND length(regexp_extract(substr(s, p0 + 1261, 240), '(?s)^.*\s')) > 0 THEN 1260 + length(regexp_extract(substr(s, p0 + 1261, 240), '(?s)^.*\s')) ELSE 1500 END) AS c FROM step)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p0) - 1)::INT AS chunk_index, regexp_replace(c, '^\s+|\s+$', '', 'g') AS chunk FROM cut WHERE regexp_matches(c, '\S')"""

SQL = {
    "memories": f"""SELECT doc_id, 'm' || doc_id AS id, {_case(dims.DOMAINS, "substr(source, 4)::INT % 6")} || '/memories/m' || doc_id || '.md' AS vault_path,
 {_case(dims.DOMAINS, "substr(source, 4)::INT % 6")} AS domain, {_case(dims.MEM_TYPES, "doc_id % 5")} AS mem_type,
 array_to_string(regexp_extract_all(text, '[^ \\n\\t\\r]+')[1:8], ' ') AS title, left(text, 280) AS summary, text AS body,
 CASE WHEN toxic = 1 THEN 'sensitive' ELSE 'normal' END AS sensitivity, CASE WHEN quality = 1 THEN 0.9::DOUBLE WHEN quality = 0 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
 {_WHEN.format(d=_DAY)} AS updated_at, {_WHEN.format(d=_DAY + " - 30")} AS created_at, CASE WHEN doc_id % 3 = 0 THEN {_WHEN.format(d=_DAY + " - 10")} END AS last_confirmed_at,
 CASE WHEN doc_id % 5 = 4 THEN strftime({_DAY} + 90, '%Y-%m-%d') END AS expires_at, (CASE WHEN doc_id % 5 = 0 THEN 180 WHEN doc_id % 5 IN (2, 3) THEN 365 END)::BIGINT AS stale_after_days,
 doc_id % 6 AS confirmation_count, CASE WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 11 = 0 THEN 'expired' ELSE 'active' END AS status, ['shelf-' || (doc_id % 97), 'lang ' || lang] AS tags, lang, source
 FROM documents LEFT JOIN labels USING (doc_id)""",
    "threads": """SELECT event_id AS id, '/home/u/ws/p' || (user_id % 40) AS cwd, event_type AS title, epoch_us(ts) // 1000000 AS updated_at, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000 END AS updated_at_ms,
 floor(abs(value))::BIGINT AS tokens_used, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS model, (event_id % 4 = 0)::INT AS archived FROM events""",
    "tasks": f"""SELECT o_orderkey AS id, 'Task ' || o_orderkey AS title,
 {_case(("push the release branch", "update notes for the team", "summarise open questions", "delete old invoices", "improve the docs", "list recent work"), "o_orderkey % 6")} AS goal,
 lower(c_mktsegment) AS domain, {_case(dims.TASK_STATUSES, "o_orderkey % 12")} AS status, {_case(("low", "medium", "high"), "o_orderkey % 3")} AS risk_level, o_orderkey % 5000 AS tokens,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS cost_usd, o_orderdate::DATE AS updated_on FROM orders JOIN customer ON c_custkey = o_custkey""",
    "approvals": """SELECT o_orderkey * 10 AS id, o_orderkey AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'denied' END AS status, o_orderdate::DATE AS requested_on FROM orders""",
    "imports": f"""SELECT page_id AS id, {_case(dims.DOMAINS, "page_id % 6")} AS domain, url AS source_url, html, CASE WHEN page_id % 9 = 0 THEN 'failed' ELSE 'passed' END AS extraction_quality_status,
 DATE '{dims.AS_OF}' - (page_id % 90)::INT AS created_on FROM pages""",
    "proposals": f"""SELECT page_id * 10 + k AS id, page_id AS import_id, {_case(dims.DOMAINS, "page_id % 6")} AS domain, CASE (page_id + k) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'discarded' END AS status,
 DATE '{dims.AS_OF}' - (page_id % 90)::INT AS created_on FROM (SELECT page_id, unnest(range(0, page_id % 4 + 1)) AS k FROM pages WHERE page_id % 7 <> 0)""",
    "chunks": f"""SELECT doc_id * 100000 + chunk_index AS id, doc_id % 300 AS import_id, {_case(dims.DOMAINS, "substr(source, 4)::INT % 6")} AS domain, chunk AS body FROM ({CHUNKS}) JOIN documents USING (doc_id)""",
    "audit": f"""SELECT event_id AS id, 'run-' || user_id AS run_id, CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR END AS task_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts,
 {_case(("tool_call", "approval", "output", "model_call", "context"), "event_id % 5")} AS kind, event_type AS summary, props AS detail, CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS tokens FROM events""",
    "agent_lines": """SELECT conv_id AS task_id, turn AS seq, CASE (conv_id + turn) % 9 WHEN 0 THEN '{"type":"thread.started","thread_id":"th"}' WHEN 1 THEN '{"type":"turn.started"}'
 WHEN 2 THEN '{"type":"turn.completed","usage":{"input_tokens":' || length(text) || ',"output_tokens":' || (turn * 7) || '}}' WHEN 3 THEN '{"type":"turn.failed","error":{"message":"it broke"}}'
 WHEN 4 THEN json_object('type', 'item.completed', 'item', json_object('type', 'agent_message', 'text', text))::VARCHAR
 WHEN 5 THEN json_object('type', 'item.completed', 'item', json_object('type', 'command_execution', 'command', left(text, 250)))::VARCHAR
 WHEN 6 THEN '{"type":"token_count","total_tokens":41}' WHEN 7 THEN '{"type":"exec.begin","command":"ls -la"}' ELSE 'plain line ' || turn END AS line FROM conversations""",
    "catalog": f"""SELECT '~/p/' || (l_partkey % 500) AS id, l_orderkey * 10 + l_linenumber AS ord, {_case(dims.KINDS, "floor(l_quantity)::INT % 8")} AS kind, p_name AS display_name,
 CASE WHEN l_linenumber % 3 <> 0 THEN p_type END AS summary, CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS category, {_case(("local", "claude", "gemini", "local"), "l_orderkey % 4")} AS provider,
 [lower(p_brand), split_part(p_type, ' ', 1)] AS tags, CASE WHEN l_linenumber % 4 <> 0 THEN date_diff('day', DATE '1970-01-01', l_shipdate::DATE) END AS updated_at,
 ([0.72, 0.82, 0.82, 0.9]::DOUBLE[])[(l_linenumber % 4)::INT + 1] AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey""",
}


def with_(*names: str) -> str:
    """The head of a DuckDB query over model tables, each prefixed with ``x_``."""
    return "WITH RECURSIVE " + ", ".join(f"x_{n} AS ({SQL[n]})" for n in names) + " "

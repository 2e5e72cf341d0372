"""Usage, lists and joins over threads, tasks, approvals and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctua.functions import dims
from noctua.operators import usage
from noctua.sources.driver import with_

from .base import query

NOW_S = 1706659200  # 2024-01-31, the end of the event data
DAY = "1998-03-05"
_ACTIVE = ", ".join(f"'{s}'" for s in dims.ACTIVE_STATUSES)
_ENDED = ", ".join(f"'{s}'" for s in dims.TERMINAL_STATUSES)
_RANK = f"CASE WHEN status = 'waiting_for_approval' THEN 0 WHEN status IN ({_ACTIVE}) THEN 1 WHEN status IN ({_ENDED}) THEN 3 ELSE 2 END"
_MS = "coalesce(updated_at_ms, updated_at * 1000)"


@query("G1_token_total", with_("threads") + "SELECT coalesce(sum(tokens_used), 0)::BIGINT AS total_tokens FROM x_threads")
def g1(t):
    return usage.token_total(t.threads)


@query("G2_thread_counts", with_("threads") + "SELECT count(*) AS threads, count(*) FILTER (archived = 0) AS active FROM x_threads")
def g2(t):
    return usage.thread_counts(t.threads)


@query("G3_workspace_count", with_("threads") + "SELECT count(DISTINCT cwd) AS workspaces FROM x_threads")
def g3(t):
    return usage.workspace_count(t.threads)


@query("G4_top_workspaces", with_("threads") + f"SELECT cwd, count(*) AS threads, sum(tokens_used)::BIGINT AS tokens, max({_MS}) AS last_ms FROM x_threads GROUP BY cwd ORDER BY tokens DESC, last_ms DESC, cwd LIMIT 6")
def g4(t):
    return usage.top_workspaces(t.threads)


@query("G5_week_trend", with_("threads") + f"SELECT strftime(DATE '1970-01-01' + (updated_at // 86400)::INT, '%m-%d') AS label, count(*) AS threads, sum(tokens_used)::BIGINT AS tokens FROM x_threads WHERE updated_at >= {NOW_S} - 518400 GROUP BY updated_at // 86400")
def g5(t):
    return usage.trend(t.threads, NOW_S)


@query("G6_day_logs", with_("threads") + f"SELECT count(*) AS logs FROM x_threads WHERE updated_at >= {NOW_S} - 86400")
def g6(t):
    return usage.recent_logs(t.threads, NOW_S)


@query("G7_recent_workspaces", with_("threads") + f"SELECT cwd, max({_MS}) AS last_ms FROM x_threads WHERE cwd <> '' GROUP BY cwd ORDER BY last_ms DESC, cwd LIMIT 24")
def g7(t):
    return usage.recent_workspaces(t.threads)


@query("G8_last_seq", "SELECT user_id AS task_id, coalesce(max(event_id), 0) AS last_seq FROM events GROUP BY user_id")
def g8(t):
    return t.events.groupBy(F.col("user_id").alias("task_id")).agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("last_seq"))


@query("G9_spend_today", with_("tasks") + f"SELECT round(coalesce(sum(cost_usd), 0), 2) AS spent FROM x_tasks WHERE updated_on = DATE '{DAY}'")
def g9(t):
    return usage.spent_on(t.tasks, DAY)


@query(
    "G10_import_status",
    with_("imports", "proposals")
    + """, n AS (SELECT import_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending FROM x_proposals GROUP BY 1)
SELECT id AS import_id, coalesce(total, 0) AS total, coalesce(pending, 0) AS pending,
CASE WHEN coalesce(total, 0) = 0 THEN 'no_candidates' WHEN pending = total THEN 'pending' WHEN pending > 0 THEN 'partial' ELSE 'completed' END AS status FROM x_imports LEFT JOIN n ON import_id = id""",
)
def g10(t):
    return usage.import_status(t.imports, t.proposals)


@query("G12_usage_by_domain", with_("tasks") + "SELECT domain, count(*) AS runs, sum(tokens)::BIGINT AS tokens, round(sum(coalesce(cost_usd, 0)), 2) AS cost_usd FROM x_tasks GROUP BY domain")
def g12(t):
    return usage.by_domain(t.tasks)


@query(
    "G13_header_metrics",
    with_("tasks")
    + f"""SELECT count(*) FILTER (status IN ({_ACTIVE})) AS running, count(*) FILTER (status = 'waiting_for_approval') AS waiting,
count(*) FILTER (status = 'completed' AND updated_on = DATE '{DAY}') AS completed_today, round(coalesce(sum(cost_usd) FILTER (updated_on = DATE '{DAY}'), 0), 2) AS spent_today FROM x_tasks""",
)
def g13(t):
    return usage.header_metrics(t.tasks, DAY)


@query(
    "G14_control_status",
    with_("tasks", "approvals", "proposals")
    + f"""SELECT (SELECT count(*) FROM x_approvals WHERE status = 'pending') AS pending_approvals, (SELECT count(*) FROM x_proposals WHERE status = 'pending') AS pending_proposals,
(SELECT count(*) FROM x_tasks WHERE status IN ({_ACTIVE})) AS running, (SELECT round(coalesce(sum(cost_usd), 0), 2) FROM x_tasks WHERE updated_on = DATE '{DAY}') AS spent_today""",
)
def g14(t):
    return usage.control_status(t.tasks, t.approvals, t.proposals, DAY)


@query("G20_month_rollup", with_("tasks") + "SELECT date_trunc('month', updated_on)::DATE AS period, domain, count(*) AS runs, sum(tokens)::BIGINT AS tokens, round(sum(coalesce(cost_usd, 0)), 2) AS cost_usd FROM x_tasks GROUP BY ALL")
def g20(t):
    return usage.rollup(t.tasks)


@query("O1_recent_threads", with_("threads") + f"SELECT id, title, cwd, {_MS} AS at_ms, nullif(model, '') AS model FROM x_threads ORDER BY at_ms DESC, id LIMIT 8")
def o1(t):
    return usage.recent_threads(t.threads)


@query("O3_task_order", with_("tasks") + f"SELECT id, status, {_RANK} AS rank, updated_on FROM x_tasks ORDER BY rank, updated_on DESC, id LIMIT 200")
def o3(t):
    return usage.task_order(t.tasks, 200)


@query("O4_oldest_approvals", with_("approvals") + "SELECT id, task_id, requested_on FROM x_approvals WHERE status = 'pending' ORDER BY requested_on, id LIMIT 50")
def o4(t):
    return t.approvals.where("status = 'pending'").orderBy("requested_on", "id").select("id", "task_id", "requested_on").limit(50)


@query("O8_clamped_limit", "SELECT doc_id, greatest(1, least(50, coalesce(nullif(doc_id % 120, 7), 8))) AS k FROM documents")
def o8(t):
    k = F.greatest(F.lit(1), F.least(F.lit(50), F.coalesce(F.nullif(F.col("doc_id") % 120, F.lit(7)), F.lit(8))))
    return t.documents.select("doc_id", k.alias("k"))


@query("P1_point_lookup", with_("memories") + "SELECT id, title, status FROM x_memories WHERE id = 'm42'")
def p1(t):
    return t.memories.where("id = 'm42'").select("id", "title", "status")


@query("P2_domain_list", with_("memories") + "SELECT id, updated_at FROM x_memories WHERE domain = 'work' AND status <> 'expired' ORDER BY updated_at DESC, id")
def p2(t):
    return t.memories.where("domain = 'work' AND status <> 'expired'").select("id", "updated_at").orderBy(F.desc("updated_at"), "id")


@query("P3_live_list", with_("memories") + "SELECT id, domain, updated_at FROM x_memories WHERE status <> 'expired' ORDER BY updated_at DESC, id")
def p3(t):
    return t.memories.where("status <> 'expired'").select("id", "domain", "updated_at").orderBy(F.desc("updated_at"), "id")


@query("P4_tree_metadata", with_("memories") + ", tree AS (SELECT DISTINCT domain || '/memories/m' || n || '.md' AS path FROM x_memories, (SELECT unnest([1, 2, 3, 5, 8, 13]) AS n)) SELECT path, title, mem_type, status FROM tree LEFT JOIN x_memories ON vault_path = path")
def p4(t):
    m = t.memories
    numbers = t.spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 8, 13)], "n int")
    tree = m.select("domain").distinct().crossJoin(F.broadcast(numbers)).select(F.concat("domain", F.lit("/memories/m"), F.col("n").cast("string"), F.lit(".md")).alias("path"))
    return tree.join(m.select(F.col("vault_path").alias("path"), "title", "mem_type", "status"), "path", "left")


@query("P5_proposal_list", with_("proposals") + "SELECT id, import_id, status, created_on FROM x_proposals WHERE status = 'pending' ORDER BY created_on DESC, id")
def p5(t):
    return t.proposals.where("status = 'pending'").select("id", "import_id", "status", "created_on").orderBy(F.desc("created_on"), "id")


@query("P6_import_list", with_("imports") + "SELECT id, domain, created_on FROM x_imports ORDER BY created_on DESC, id LIMIT 100")
def p6(t):
    return t.imports.select("id", "domain", "created_on").orderBy(F.desc("created_on"), "id").limit(100)


@query("P7_optional_filters", with_("memories") + "SELECT id FROM x_memories WHERE (NULL::VARCHAR IS NULL OR domain = NULL) AND status <> 'expired' AND (0 = 1 OR status <> 'stale')")
def p7(t):
    from noctua.operators.search import visible

    return t.memories.where(visible(None, include_stale=False)).select("id")


@query("P8_events_since", "SELECT event_id, event_type, value FROM events WHERE user_id = 7 AND event_id > 100 ORDER BY event_id")
def p8(t):
    return t.events.where("user_id = 7 AND event_id > 100").select("event_id", "event_type", "value").orderBy("event_id")


@query("P9_run_trace", with_("audit") + "SELECT id, kind, summary, detail ->> '$.k' AS k FROM x_audit WHERE run_id = 'run-7' ORDER BY id")
def p9(t):
    return t.audit.where("run_id = 'run-7'").select("id", "kind", "summary", F.get_json_object("detail", "$.k").alias("k")).orderBy("id")


@query("P10_active_count", with_("tasks") + f"SELECT count(*) AS running FROM x_tasks WHERE status IN ({_ACTIVE})")
def p10(t):
    return usage.active_count(t.tasks)


@query("P11_scaled_projection", with_("threads") + "SELECT id, updated_at * 1000 AS at_ms, nullif(model, '') AS model FROM x_threads")
def p11(t):
    return t.threads.select("id", (F.col("updated_at") * 1000).alias("at_ms"), F.nullif("model", F.lit("")).alias("model"))


@query("P12_task_runs", with_("tasks") + "SELECT id AS run_id, title, status, tokens, cost_usd FROM x_tasks")
def p12(t):
    return t.tasks.select(F.col("id").alias("run_id"), "title", "status", "tokens", "cost_usd")


#: Steps of completed tasks: of the trace the first 25 that tell something, else the planned ones.
SKILL_STEPS = """, done AS (SELECT id FROM x_tasks WHERE status = 'completed'), r AS (SELECT task_id::BIGINT AS task_id, id AS ord, summary, row_number() OVER (PARTITION BY task_id ORDER BY id) AS n FROM x_audit WHERE task_id IS NOT NULL AND kind IN ('tool_call', 'approval', 'output') AND trim(summary) <> ''),
steps AS (SELECT task_id, ord, summary FROM r WHERE n <= 25 AND task_id IN (SELECT id FROM done) UNION ALL SELECT id, i, ['Plan', 'Execute', 'Verify'][i + 1] FROM done, (SELECT unnest([0, 1, 2]) AS i) WHERE id NOT IN (SELECT task_id FROM r))"""


def skill_steps(t):
    """Runs of the log are named by their task here."""
    from noctua.operators import events

    log = t.audit.where("task_id IS NOT NULL").withColumn("run_id", F.col("task_id"))
    return events.skill_steps(log, t.tasks, events.default_steps(t.tasks))


@query("P13_trace_steps", with_("audit", "tasks") + SKILL_STEPS + " SELECT task_id, ord::BIGINT AS ord, summary FROM steps")
def p13(t):
    return skill_steps(t)


@query("P14_catalog_filter", with_("catalog") + "SELECT ord, display_name FROM x_catalog WHERE kind = 'skill' AND contains(lower(concat_ws(' ', id, display_name, summary, category, provider, array_to_string(tags, ' '))), 'widget')")
def p14(t):
    from noctua.operators.catalog import matching

    return matching(t.catalog, "skill", " Widget ").select("ord", "display_name")


@query("P15_page", with_("catalog") + "SELECT ord, display_name FROM x_catalog ORDER BY display_name, ord LIMIT 8 OFFSET 16")
def p15(t):
    from noctua.operators.catalog import page

    return page(t.catalog.select("ord", "display_name"), ["display_name", "ord"], 3)


@query("P16_pending_split", with_("proposals") + "SELECT CASE WHEN status = 'pending' THEN 'pending' ELSE 'activity' END AS part, count(*) AS n FROM x_proposals GROUP BY 1")
def p16(t):
    return t.proposals.groupBy(F.when(F.col("status") == "pending", "pending").otherwise("activity").alias("part")).agg(F.count("*").alias("n"))


@query("J3_pending_approvals", with_("tasks", "approvals") + "SELECT a.id, task_id, title, risk_level, requested_on FROM x_approvals a JOIN x_tasks t ON t.id = a.task_id WHERE a.status = 'pending' ORDER BY requested_on, a.id")
def j3(t):
    a = t.approvals.where("status = 'pending'").select("id", "task_id", "requested_on")
    return a.join(t.tasks.select(F.col("id").alias("task_id"), "title", "risk_level"), "task_id").orderBy("requested_on", "id")


@query("J4_imports_without_chunks", with_("imports", "chunks") + "SELECT i.id FROM x_imports i LEFT JOIN x_chunks c ON c.import_id = i.id WHERE extraction_quality_status <> 'failed' GROUP BY i.id HAVING count(c.id) = 0")
def j4(t):
    return t.imports.where("extraction_quality_status <> 'failed'").select("id").join(t.chunked_imports.select(F.col("import_id").alias("id")), "id", "left_anti")


def _files(t):
    """A vault listing that lacks some files and has others changed."""
    m = t.memories.where("doc_id % 13 <> 5")
    body = F.when(F.col("doc_id") % 17 == 3, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    return m.select("id", F.col("vault_path").alias("path"), F.sha2(body, 256).alias("content_hash"), F.lit("file").alias("kind"))


_FILES = ", f AS (SELECT id, vault_path AS path, sha256(CASE WHEN doc_id % 17 = 3 THEN body || '!' ELSE body END) AS content_hash FROM x_memories WHERE doc_id % 13 <> 5) "


@query("J5_orphans", with_("memories") + _FILES + "SELECT id, vault_path FROM x_memories WHERE vault_path NOT IN (SELECT path FROM f)")
def j5(t):
    return t.memories.select("id", "vault_path").join(_files(t).select(F.col("path").alias("vault_path")), "vault_path", "left_anti")


@query("J6_drift", with_("memories") + _FILES + "SELECT f.id FROM f JOIN x_memories m USING (id) WHERE sha256(m.body) <> f.content_hash")
def j6(t):
    from noctua.operators.lifecycle import drifted

    return drifted(_files(t), t.memories.select("id", F.sha2("body", 256).alias("content_hash"))).select("id")


@query("J7_deleted_rows", with_("memories") + "SELECT id FROM x_memories WHERE id NOT IN (SELECT id FROM x_memories WHERE domain = 'finance')")
def j7(t):
    m = t.memories.select("id", "domain")
    return m.join(m.where("domain = 'finance'").select("id"), "id", "left_anti").select("id")


@query("J8_open_approval", with_("tasks", "approvals") + "SELECT t.id, min(a.id) AS approval_id FROM x_tasks t LEFT JOIN x_approvals a ON a.task_id = t.id AND a.status = 'pending' GROUP BY t.id")
def j8(t):
    first = t.approvals.where("status = 'pending'").groupBy(F.col("task_id").alias("id")).agg(F.min("id").alias("approval_id"))
    return t.tasks.select("id").join(first, "id", "left")


@query("J9_category_lookup", with_("catalog") + "SELECT ord, p_type AS category FROM x_catalog c LEFT JOIN (SELECT p_name, min(p_type) AS p_type FROM part GROUP BY 1) ON p_name = display_name")
def j9(t):
    index = t.part.groupBy(F.col("p_name").alias("display_name")).agg(F.min("p_type").alias("category"))
    return t.catalog.select("ord", "display_name").join(index, "display_name", "left").select("ord", "category")


@query("J10_allowed_roots", with_("threads") + "SELECT DISTINCT cwd FROM x_threads WHERE cwd IN ('/home/u/ws/p1', '/home/u/ws/p3', '/elsewhere')")
def j10(t):
    allowed = t.spark.createDataFrame([("/home/u/ws/p1",), ("/home/u/ws/p3",), ("/elsewhere",)], "cwd string")
    return t.threads.select("cwd").distinct().join(F.broadcast(allowed), "cwd", "left_semi")


@query("S20_source_list", "SELECT * FROM (VALUES ('documents', 'available'), ('nothing', 'missing')) x(name, status)")
def s20(t):
    from noctua.sources.tables import availability

    return availability(t.spark, {"documents": f"{t.sf_dir}/documents.parquet", "nothing": f"{t.sf_dir}/nothing.parquet"})


@query("T15_status_tones", with_("tasks") + """SELECT id, CASE WHEN status IN ('running', 'waiting_for_tool', 'resuming', 'verifying') THEN 'accent' WHEN status = 'waiting_for_approval' THEN 'warning' WHEN status = 'completed' THEN 'success' WHEN status = 'failed' THEN 'danger' ELSE 'neutral' END AS tone,
upper(left(status, 1)) || replace(substr(status, 2), '_', ' ') AS label, CASE risk_level WHEN 'low' THEN 'neutral' WHEN 'medium' THEN 'warning' ELSE 'danger' END AS risk_tone FROM x_tasks""")
def t15(t):
    from noctua.functions import display

    return t.tasks.select("id", display.status_tone(F.col("status")).alias("tone"), display.status_label(F.col("status")).alias("label"), display.risk_tone(F.col("risk_level")).alias("risk_tone"))


@query("F4_run_traces", with_("audit") + "SELECT run_id, id, kind, detail ->> '$.k' AS k FROM x_audit WHERE run_id IN ('run-1', 'run-2')")
def f4(t):
    return t.audit.where("run_id IN ('run-1', 'run-2')").select("run_id", "id", "kind", F.get_json_object("detail", "$.k").alias("k"))


@query("F7_decided_approvals", with_("approvals") + "SELECT id, CASE WHEN task_id % 4 = 0 THEN 'approved' WHEN task_id % 4 = 1 THEN 'denied' ELSE status END AS status FROM x_approvals")
def f7(t):
    """Approvals after decisions; a decision counts whatever the state before it."""
    a = t.approvals
    d = a.where("task_id % 4 < 2").select("id", F.when(F.col("task_id") % 4 == 0, "approved").otherwise("denied").alias("decided"))
    return a.join(d, "id", "left").select("id", F.coalesce("decided", "status").alias("status"))


@query("S1_declared_schema", with_("tasks") + "SELECT id, status, cost_usd FROM x_tasks")
def s1(t):
    """Stored tasks, read with a schema that declares a column the file does not have."""
    from noctua.sources.tables import append

    declared = t.spark.createDataFrame([], "id bigint, status string, cost_usd double, later string")
    return append(declared, t.tasks.select("id", "status", "cost_usd")).select("id", "status", "cost_usd")


@query("S17_path_guard", "SELECT page_id, NOT list_contains(string_split(path, '/'), '..') AND NOT starts_with(path, '/') AS safe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'work/' || page_id || '.md' WHEN 1 THEN '../' || page_id ELSE '/etc/' || page_id END AS path FROM pages)")
def s17(t):
    from noctua.functions.text import safe_relative

    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("work/"), i, F.lit(".md"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("../"), i)).otherwise(F.concat(F.lit("/etc/"), i))
    return t.pages.select("page_id", safe_relative(path).alias("safe"))


@query("A11_query_guards", "SELECT item_id, CASE WHEN length(trim(text)) = 0 THEN 'blank' WHEN length(text) > 300 THEN 'long' END AS refusal FROM benchmark")
def a11(t):
    """Which questions a search would refuse, with a bound of 300 characters instead of 1000."""
    from noctua.operators.search import refusal

    return t.benchmark.select("item_id", refusal(F.col("text"), 300).alias("refusal"))


@query("S4_vault_walk", with_("memories") + "SELECT vault_path AS path, domain FROM x_memories")
def s4(t):
    """Paths of a listing that lie in the vault: of its domains, neither archived nor hidden."""
    from noctua.sources.vault import in_vault

    m = t.memories.select(F.col("vault_path").alias("path"), "domain")
    more = m.select(F.concat(F.lit("_archive/"), "path").alias("path"), "domain").union(m.select(F.concat(F.lit(".git/"), "path"), "domain"))
    return m.union(more).where(in_vault(F.col("path")))

import pytest
from pyspark.sql import functions as F

from noctua.api import Store
from noctua.operators import audit

DAY = "2026-07-01"


def store(spark):
    m = "id string, doc_id int, vault_path string, domain string, mem_type string, title string, summary string, body string, sensitivity string, confidence double, updated_at string, created_at string, last_confirmed_at string, expires_at string, stale_after_days int, confirmation_count int, status string"
    rows = [
        ("m1", 1, "work/memories/m1.md", "work", "fact", "Gateway tokens", "s", "The gateway signs tokens. Tokens expire after an hour.", "normal", 0.9, DAY, DAY, DAY, None, 180, 1, "active"),
        ("m2", 2, "work/memories/m2.md", "work", "fact", "Lunch", "s", "Menu of the day.", "normal", 0.9, "2025-01-01", "2025-01-01", None, None, 180, 1, "active"),
    ]
    tasks = [(1, "t1", "push it", "work", "waiting_for_approval", "high", 5, 1.5, DAY), (2, "t2", "read", "work", "running", "low", 7, None, DAY)]
    tables = {
        "memories": spark.createDataFrame(rows, m),
        "tasks": spark.createDataFrame(tasks, "id bigint, title string, goal string, domain string, status string, risk_level string, tokens bigint, cost_usd double, updated_on string").withColumn("updated_on", F.col("updated_on").cast("date")),
        "approvals": spark.createDataFrame([(9, 1, "pending", DAY)], "id bigint, task_id bigint, status string, requested_on string"),
        "chunks": spark.createDataFrame([(4, 7, "work", "Gateway tokens are renewed each hour by the client.")], "id bigint, import_id bigint, domain string, body string"),
        "imports": spark.createDataFrame([(7, "work", "T", "c", "text", "passed", DAY)], "id bigint, domain string, title string, content string, input_kind string, extraction_quality_status string, created_on string"),
        "audit": audit.appended(spark.createDataFrame([(1, "1", "1", DAY, "tool_call", "ls", "{}", None, None), (2, "1", "1", DAY, "output", "done", "{}", 3, 0.5)], "id bigint, run_id string, task_id string, ts string, kind string, summary string, detail string, tokens bigint, cost_usd double")),
    }
    return Store(spark, DAY, tables)


def test_reads(spark):
    s = store(spark)
    assert tuple(s.control_status().first()) == (1, 0, 1, 1.5, True)
    assert [r.id for r in s.memory_search("gateway").collect()] == ["m1"] and s.approvals_list().first().title == "t1"
    assert s.tasks_get(1).first().last_seq == 0 and s.audit_trace("1").count() == 2 and s.memory_read("work/memories/m2.md").first().status == "active"
    assert s.get_app_snapshot(0)["counts"].first().skill == 0 and s.memory_proposals_list("pending").count() == 0
    with pytest.raises(ValueError):
        s.memory_proposals_list("odd")


def test_ask_is_grounded(spark):
    s = store(spark)
    e = s.memory_evidence("gateway tokens", "work").orderBy("number").collect()
    assert [r.number for r in e] == [1, 2] and {r.path for r in e} == {"work/memories/m1.md", "import/7"}
    ours = next(r.number for r in e if r.path.startswith("work"))
    claims = spark.createDataFrame([(1, "The gateway signs tokens", [ours]), (2, "The gateway sings songs", [1, 2])], "claim_no int, text string, citations array<int>")
    got = s.memory_ask("gateway tokens", "work", claims).collect()
    assert len(got) == 1 and got[0].answer == "The gateway signs tokens [1]." and got[0].sources == 1
    no = s.memory_ask("gateway tokens", "work", claims.where("claim_no = 2"))
    assert [(r.abstained, r.answer, r.sources) for r in no.collect()] == [(True, None, 0)] and no.first().warning
    row = s.memory_ask_audit("q1", no).first()
    assert (row.id, row.run_id, row.kind, row.prev_hash) == (3, "memory-ask:q1", "memory_ask_abstained", s["audit"].orderBy(F.desc("id")).first().hash)
    with pytest.raises(ValueError):
        s.memory_evidence("x", "work")


def test_writes_return_what_changes(spark):
    s = store(spark)
    out = s.tasks_submit(spark.createDataFrame([(5, "deploy now", "work"), (6, "summarise", "work")], "id bigint, goal string, domain string"))
    assert {(r.id, r.status) for r in out["tasks"].collect()} == {(5, "waiting_for_approval"), (6, "planned")}
    assert out["task_steps"].count() == 6 and out["approvals"].count() == 1 and out["audit"].count() == 4
    assert {(r.id, r.status) for r in s.tasks_cancel(2).collect()} == {(1, "waiting_for_approval"), (2, "cancelled")}
    d = spark.createDataFrame([(1, False, None)], "task_id bigint, approve boolean, reason string")
    assert {(r.id, r.status, r.failure) for r in s.approvals_decide(d).collect()} == {(1, "cancelled", "Denied"), (2, "running", None)}
    assert {(r.id, r.status) for r in s.memory_maintenance_run().collect()} == {("m1", "active"), ("m2", "stale")}
    assert s.memory_confirm(["m2"]).where("id = 'm2'").first().confirmation_count == 2
    assert s.skills_distill().count() == 0  # no task is completed
    done = s["tasks"].withColumn("status", F.when(F.col("id") == 2, "failed").otherwise("completed"))
    steps = spark.createDataFrame([(k, i, t) for k in (1, 2, 3) for i, t in enumerate(("Plan", "Execute"))], "task_id bigint, step_index int, title string")
    more = done.unionByName(done.where("id = 1").withColumn("id", F.lit(3).cast("bigint"))).unionByName(done.where("id = 1").withColumn("id", F.lit(4).cast("bigint")))
    told = Store(spark, DAY, {"tasks": more, "task_steps": steps, "audit": s["audit"]}).skills_distill()
    assert {r.task_id: r.body for r in told.collect()} == {1: "1. ls\n2. done", 3: "1. Plan\n2. Execute", 4: ""}
    for rows in (s.memory_answer_feedback("a", "what?", "work", "flagged"), out["audit"], s.memory_gate_audit(spark.createDataFrame([(2, "secrets"), (1, "type")], "request_id int, reject_reason string"))):
        log = s["audit"].unionByName(rows)
        assert audit.verified(log).first().ok and log.count() > 2
    with pytest.raises(ValueError):
        s.memory_answer_feedback("a", "what?", "work", "approved")


def test_search_touches_what_it_returns(spark):
    s = store(spark)
    got = {r.id: (r.access_count, r.last_accessed_at) for r in s.memory_search_touch(s.memory_search("gateway")).collect()}
    assert got == {"m1": (1, DAY), "m2": (0, None)}


def test_decided_proposals_are_applied_unless_the_memory_has_changed(spark):
    s = store(spark)
    hashes = {r.id: r.h for r in s["memories"].select("id", F.sha2("body", 256).alias("h")).collect()}
    rows = [(1, "pending", "update", "m1", hashes["m1"], "Tokens last a day."), (2, "pending", "update", "m2", "old", "x"), (3, "pending", "create", None, None, "New"), (4, "discarded", "create", None, None, "Never"), (5, "pending", "create", None, None, "Not yet")]
    s.tables["proposals"] = spark.createDataFrame([(k, 7, "work", st, DAY, op, to, h, "fact", "T", b, None) for k, st, op, to, h, b in rows], "id bigint, import_id bigint, domain string, status string, created_on string, op string, target_id string, base_hash string, mem_type string, title string, body string, valid_from string")
    out = s.memory_proposals_decide(spark.createDataFrame([(k, k != 5, 1) for k in range(1, 6)], "id bigint, approve boolean, at int"))
    assert {r.id: r.status for r in out["proposals"].collect()} == {1: "approved", 2: "pending", 3: "approved", 4: "discarded", 5: "discarded"}
    m = {r.id: r for r in out["memories"].collect()}
    assert set(m) == {"m1", "m2", "p3"} and "Tokens last a day." in m["m1"].body and m["m2"].body == "Menu of the day."


def test_imports_without_passages_are_cut_before_they_are_asked(spark):
    s = store(spark)
    s.tables["imports"] = spark.createDataFrame([(8, "work", "T", "The gateway rotates its signing keys weekly.", "text", "passed", DAY)], "id bigint, domain string, title string, content string, input_kind string, extraction_quality_status string, created_on string")
    assert "import/8" in {r.path for r in s.memory_evidence("gateway signing keys", "work").collect()}


def test_save_updates_the_same_title_and_routes(spark):
    c = "request_id int, mem_type string, domain string, title string, body string, valid_from string, valid_until string, expires string, stale_after_days int, confidence double, source string"
    rows = [(1, "fact", "work", "gateway TOKENS", "new", None, None, None, None, None, "manual"), (2, "preference", "work", "Tea", "green", None, None, None, None, 0.9, "chat:1"), (3, "fact", "family", "Pets", "cat", None, None, None, None, None, "manual")]
    got = {r.request_id: r for r in store(spark).memory_save_manual(spark.createDataFrame(rows, c)).collect()}
    assert (got[1].op, got[1].target_id, got[1].needs_approval) == ("update", "m1", False)
    assert (got[2].op, got[2].confidence, got[2].needs_approval) == ("create", 0.5, True) and got[3].needs_approval


def test_import_to_candidates(spark):
    text = "# API\nRequests require authentication with a signed JWT in the header of each call.\n\n# Limits\nThe timeout of the endpoint must be one hour at most, and retries are required.\n"
    raw = spark.createDataFrame([(1, "work", "Guide", "text", text), (2, "work", "Bad", "text", text + "\npassword: hunter2"), (3, "work", "None", "text", None)], "id bigint, domain string, title string, input_kind string, content string")
    got = {r.id: r for r in store(spark).memory_import_document(raw).collect()}
    assert (got[1].status, got[1].candidates, got[1].chunks) == ("pending", 2, 1)
    assert (got[2].status, got[2].refusal) == ("rejected", "secrets") and got[3].refusal == "empty"
    assert store(spark).memory_import_candidates(raw).count() == 2


def test_a_store_with_a_folder_keeps_indexes_and_passages(spark, tmp_path):
    s = store(spark)
    s.folder = f"file://{tmp_path}/kept"
    m = s["memories"].withColumn("tags", F.when(F.col("id") == "m2", F.array(F.lit("canteen"))))
    s.tables["memories"] = m
    assert [r.id for r in s.memory_search("canteen").collect()] == ["m2"]
    s.tables["memories"] = m.withColumn("title", F.when(F.col("id") == "m2", "Supper").otherwise(F.col("title"))).withColumn("tags", F.lit(None).cast("array<string>")).withColumn("status", F.when(F.col("id") == "m1", "expired").otherwise(F.col("status")))
    index = s.memory_index_changed(spark.createDataFrame([("m1",), ("m2",)], "id string"))
    assert index.n == 1 and [r.id for r in s.memory_search("supper").collect()] == ["m2"] and s.memory_search("gateway").count() == s.memory_search("canteen").count() == 0
    asked = spark.createDataFrame([(1, "supper", "work"), (2, "supper", "finance")], "q int, query string, domain string")
    assert [(r.q, r.id) for r in s.memory_search_questions(asked).collect()] == [(1, "m2")]
    s.tables["imports"] = s["imports"].union(spark.createDataFrame([(8, "work", "T", "Renewed gateway tokens of import eight", "text", "passed", DAY)], s["imports"].schema))
    first = {r.path for r in s.memory_evidence("gateway tokens", "work").collect()}
    files = set(spark.read.parquet(f"{s.folder}/passages").inputFiles())
    assert first == {"import/7", "import/8"} and {r.path for r in s.memory_evidence("gateway tokens", "work").collect()} == first
    assert set(spark.read.parquet(f"{s.folder}/passages").inputFiles()) == files
    s.folder = None
    assert {r.path for r in s.memory_evidence("gateway tokens", "work").collect()} == first
    with pytest.raises(ValueError):
        s.memory_search_questions(asked)

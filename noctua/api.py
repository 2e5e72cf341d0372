"""The commands of the application as functions over a store of tables.

A store names its tables; any may be missing, and counts as empty then. Reads return DataFrames. Writes return the rows
to append or the table as it is afterwards, and change nothing in place: the caller stores the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.functions import dims
from noctua.operators import audit, catalog, documents, events, gate, imports, lifecycle, search, usage, verify
from noctua.operators.index import Index
from noctua.sources.tables import exists

SCHEMAS = {
    "tasks": "id bigint, title string, goal string, domain string, status string, risk_level string, tokens bigint, cost_usd double, updated_on date",
    "task_steps": "task_id bigint, step_index int, title string",
    "events": "task_id bigint, seq bigint, ts string, kind string, payload string",
    "approvals": "id bigint, task_id bigint, status string, requested_on date",
    "audit": "id bigint, run_id string, task_id string, ts string, kind string, summary string, detail string, tokens bigint, cost_usd double, prev_hash string, hash string",
    "memories": "doc_id bigint, id string, vault_path string, domain string, mem_type string, title string, summary string, body string, sensitivity string, confidence double, updated_at string, created_at string, last_confirmed_at string, expires_at string, stale_after_days bigint, confirmation_count bigint, status string",
    "proposals": "id bigint, import_id bigint, domain string, status string, created_on date, op string, target_id string, base_hash string, mem_type string, title string, body string, valid_from string",
    "imports": "id bigint, domain string, title string, content string, input_kind string, extraction_quality_status string, created_on date",
    "chunks": "id bigint, import_id bigint, domain string, body string",
    "threads": "id bigint, cwd string, title string, updated_at bigint, updated_at_ms bigint, tokens_used bigint, model string, archived int",
    "catalog": "id string, ord bigint, kind string, display_name string, summary string, category string, provider string, tags array<string>, updated_at bigint, confidence double",
}


@dataclass
class Store:
    """Tables by name, and the day on which they are looked at. In ``folder``, which all machines share, search indexes and cut
    passages are kept; without one, terms are counted and imports cut anew for each search."""

    spark: SparkSession
    as_of: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    folder: str | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], SCHEMAS[name])

    def _chained(self, rows: DataFrame, order: str) -> DataFrame:
        """New audit rows (run_id, task_id, kind, summary, detail) in the given order, numbered and chained to the log's last row."""
        last = self["audit"].orderBy(F.desc("id")).select("id", "hash").limit(1).collect()
        number, link = (last[0].id, last[0].hash) if last else (0, audit.GENESIS)
        rows = rows.withColumn("id", F.row_number().over(Window.orderBy(order)).cast("bigint") + number)  # of the new rows only
        text = {x: F.col(x) if x in rows.columns else F.lit(None) for x in ("task_id", "detail")}
        rows = rows.select("id", "run_id", text["task_id"].cast("string").alias("task_id"), F.lit(f"{self.as_of}T00:00:00Z").alias("ts"), "kind", "summary", F.coalesce(text["detail"].cast("string"), F.lit("{}")).alias("detail"), F.lit(None).cast("bigint").alias("tokens"), F.lit(None).cast("double").alias("cost_usd"))
        return audit.appended(rows, link)

    def _index(self, name: str, rows: DataFrame, fields: tuple[str, ...]) -> Index | None:
        """The kept index of a table, built when it is first asked for."""
        if self.folder is None:
            return None
        path = f"{self.folder}/index-{name}"
        return Index(self.spark, path) if Index.there(self.spark, path) else Index.build(rows, path, fields)

    # overview

    def get_app_snapshot(self, now_s: int) -> dict[str, DataFrame]:
        """The sections of the overview."""
        items = catalog.merged(self["catalog"])
        t = self["threads"]
        return {
            "catalog": catalog.ordered(items), "counts": catalog.counts(items), "recent_threads": usage.recent_threads(t), "totals": usage.token_total(t).crossJoin(usage.thread_counts(t)).crossJoin(usage.workspace_count(t)),
            "top_workspaces": usage.top_workspaces(t), "trend": usage.trend(t, now_s),
        }

    refresh_app_snapshot = get_app_snapshot

    def control_status(self) -> DataFrame:
        out = usage.control_status(self["tasks"], self["approvals"], self["proposals"], self.as_of)
        return out.crossJoin(audit.verified(self["audit"]).select(F.col("ok").alias("chain_ok")))

    # tasks and approvals

    def tasks_list(self) -> DataFrame:
        return self["tasks"].orderBy(F.desc("updated_on"), "id")

    def tasks_get(self, task_id: int) -> DataFrame:
        return events.task_detail(self["tasks"].where(F.col("id") == task_id), self["task_steps"], self["events"])

    def tasks_events_since(self, task_id: int, seq: int) -> DataFrame:
        return self["events"].where((F.col("task_id") == task_id) & (F.col("seq") > seq)).orderBy("seq")

    def tasks_submit(self, goals: DataFrame) -> dict[str, DataFrame]:
        """Rows that submitting goals (id, goal, domain) adds: tasks, steps, approvals, audit rows."""
        level, approval, sandbox = gate.goal_policy(F.col("goal"))
        t = goals.withColumns({"risk_level": level, "needs_approval": approval, "sandbox": sandbox, "title": F.when(F.length(F.trim("goal")) <= 64, F.trim("goal")).otherwise(F.concat(F.left(F.trim("goal"), F.lit(61)), F.lit("...")))})
        t = t.withColumn("status", F.when(F.col("needs_approval"), "waiting_for_approval").otherwise("planned"))
        said = F.array(F.lit("Task submitted"), F.concat(F.lit("Policy: "), F.col("risk_level")))
        return {
            "tasks": t,
            "task_steps": events.default_steps(t),
            "approvals": t.where("needs_approval").select(F.col("id").alias("task_id"), F.lit("pending").alias("status"), F.lit(self.as_of).cast("date").alias("requested_on")),
            "audit": self._chained(
                t.select("id", F.col("id").cast("string").alias("run_id"), F.col("id").cast("string").alias("task_id"), F.lit("policy").alias("kind"), F.posexplode(said).alias("step", "summary")).withColumn("place", F.struct("id", "step")), "place"
            ),
        }

    def tasks_cancel(self, task_id: int) -> DataFrame:
        """Tasks after one was cancelled, with the reason."""
        hit = F.col("id") == task_id
        return self["tasks"].withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).withColumn("failure", F.when(hit, "Cancelled by user"))

    def approvals_list(self) -> DataFrame:
        pending = self["approvals"].where("status = 'pending'").select("id", "task_id", "requested_on")
        return pending.join(self["tasks"].select(F.col("id").alias("task_id"), "title", "risk_level"), "task_id").orderBy("requested_on", "id")

    def approvals_decide(self, decisions: DataFrame) -> DataFrame:
        """State of tasks after decisions (task_id, approve, reason)."""
        return events.approval_effects(self["tasks"], decisions)

    # audit

    def audit_runs(self) -> DataFrame:
        return self["tasks"].select(F.col("id").alias("run_id"), "title", "status", "tokens", "cost_usd")

    def audit_trace(self, run_id: str) -> DataFrame:
        return self["audit"].where(F.col("run_id") == run_id).withColumn("detail", F.try_parse_json("detail")).orderBy("id")

    def audit_verify_chain(self) -> DataFrame:
        return audit.verified(self["audit"])

    # memory

    def memory_tree(self, files: DataFrame) -> DataFrame:
        """Files (path) with what the index knows of them."""
        m = self["memories"].select(F.col("vault_path").alias("path"), "title", "mem_type", "status")
        return files.join(m, "path", "left").orderBy("path")

    def memory_read(self, path: str) -> DataFrame:
        m = self["memories"].where(F.col("vault_path") == path)
        return m.select(F.col("vault_path").alias("path"), "body", F.coalesce("status", F.lit("active")).alias("status"))

    def _memory_index(self) -> Index | None:
        return self._index("memories", self["memories"].where("status <> 'expired'"), search.FIELDS)

    def memory_search(self, query: str, domain: str | None = None, include_stale: bool = True, limit: int = 8) -> DataFrame:
        return search.search(self["memories"], query, self.as_of, domain, include_stale, limit, self._memory_index())

    def memory_search_questions(self, questions: DataFrame, limit: int = 8) -> DataFrame:
        """(q, rank, id, score, relevance) for a table of questions (q, query, domain) in one job; needs a folder."""
        if self.folder is None:
            raise ValueError("a table of questions is searched on a kept index: give the store a folder")
        return search.search_questions(self["memories"], questions, self.as_of, self._memory_index(), limit)

    def memory_index_changed(self, ids: DataFrame) -> Index | None:
        """Take into the index what became of the memories of ``ids`` (id): new, changed, expired or gone. To be called once a write
        is stored, as the tables of this store; a search before it reads the index as it was."""
        index = self._memory_index()
        if index is None:
            return None
        ids = ids.select("id").distinct()
        live = self["memories"].where("status <> 'expired'").join(ids, "id", "left_semi")
        return index.changed(live, ids)

    def memory_search_touch(self, found: DataFrame) -> DataFrame:
        """Memories after a search that returned ``found``: one access more for those, on this day."""
        return lifecycle.accessed(self["memories"], found.select("id"), self.as_of)

    def _passages(self) -> tuple[DataFrame, Index | None]:
        """Source passages and their index. Imports that were not cut yet are, once: what is cut is stored, and indexed as a change."""
        known = self["chunks"].select("id", "import_id", "domain", "body")
        path = f"{self.folder}/passages"
        stored = self.folder is not None and exists(self.spark, path)
        have = known.unionByName(self.spark.read.parquet(path)) if stored else known
        bare = self["imports"].where("extraction_quality_status <> 'failed' AND content IS NOT NULL").join(have.select(F.col("import_id").alias("id")).distinct(), "id", "left_anti")
        cut = documents.chunked(bare.select(F.col("id").alias("import_id"), "domain", F.col("content").alias("text")))
        cut = cut.select((-1 - F.col("import_id") * 100_000 - F.col("chunk_index")).alias("id"), "import_id", "domain", F.col("chunk").alias("body"))
        if self.folder is None:
            return known.unionByName(cut), None
        if not bare.isEmpty():
            index = self._index("passages", have, ("body",))
            new = f"{self.folder}/passages-new-{index.version}"
            cut.write.mode("overwrite").parquet(new)
            cut = self.spark.read.parquet(new)
            cut.write.mode("append").parquet(path)
            index.changed(cut)
        all_ = known.unionByName(self.spark.read.parquet(path)) if exists(self.spark, path) else known
        return all_, self._index("passages", all_, ("body",))

    def memory_evidence(self, question: str, domain: str, include_stale: bool = True) -> DataFrame:
        """(number, path, text, score): the passages an answer may cite, numbered from 1."""
        if len(question.strip()) < 2:
            raise ValueError("a question has at least two characters")
        m = self.memory_search(question, domain, include_stale).where("rank <= 6")
        own = m.select(F.struct(F.col("score"), F.col("vault_path").alias("path"), F.left("body", F.lit(1800)).alias("text"), F.col("rank").cast("int").alias("ord")).alias("e"))
        chunks, index = self._passages()
        hits = search.passages(chunks, self["imports"], question, domain, 8, index).join(chunks.select("id", "body"), "id")
        from_files = hits.select(F.struct("score", F.concat(F.lit("import/"), F.col("import_id").cast("string")).alias("path"), F.left("body", F.lit(1800)).alias("text"), (F.row_number().over(Window.orderBy(F.desc("score"), "id")) + 100).alias("ord")).alias("e"))
        rows = own.union(from_files).agg(F.collect_list("e").alias("es")).select(F.posexplode(search.fused(F.col("es"))).alias("number", "e"))
        return rows.select((F.col("number") + 1).alias("number"), "e.path", "e.text", "e.score")

    def memory_ask(self, question: str, domain: str, claims: DataFrame, include_stale: bool = True) -> DataFrame:
        """One row: the verified answer from claims (claim_no, text, citations) that a model has made of the evidence, or an
        abstention with a warning if none holds."""
        one = lambda df: df.withColumn("question_id", F.lit(1))
        evidence = one(self.memory_evidence(question, domain, include_stale))
        found = verify.answers(verify.accepted(one(claims), evidence), evidence)
        asked = self.spark.createDataFrame([(1,)], "question_id int").join(found, "question_id", "left").withColumn("abstained", F.col("answer").isNull())
        warning = F.when(F.col("abstained"), "no claim is supported by the evidence")
        return asked.withColumns({"sources": F.coalesce("sources", F.lit(0)), "score": F.coalesce("score", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit("low")), "warning": warning})

    def memory_ask_audit(self, answer_id: str, answer: DataFrame) -> DataFrame:
        """The chained audit row of an answer of ``memory_ask``, or of its abstention."""
        kind = F.when(F.col("abstained"), "memory_ask_abstained").otherwise("memory_ask_answer")
        detail = F.to_json(F.struct("sources", "score", "confidence"))
        return self._chained(answer.select("question_id", F.lit(f"memory-ask:{answer_id}").alias("run_id"), kind.alias("kind"), F.coalesce("answer", "warning").alias("summary"), detail.alias("detail")), "question_id")

    def memory_answer_feedback(self, answer_id: str, question: str, domain: str, value: str) -> DataFrame:
        """The chained audit row of a reader's mark on an answer; ``flagged`` is the only mark."""
        if value != "flagged" or domain not in dims.DOMAINS or len(question.strip()) < 2 or len(question) > 1000:
            raise ValueError("invalid answer feedback")
        return self._chained(self.spark.createDataFrame([(f"memory-ask:{answer_id}", "memory_ask_feedback", value)], "run_id string, kind string, summary string"), "run_id")

    def memory_context(self, query: str, domain: str) -> DataFrame:
        return search.context(self.memory_search(query, domain))

    def memory_save_manual(self, requests: DataFrame) -> DataFrame:
        """Judged requests with operation, target and route."""
        r = gate.judged(requests)
        similar = gate.similar_titles(r.where("reject_reason IS NULL"), self["memories"]).select("request_id", F.col("memory_id").alias("similar_id"))
        r = r.join(similar, "request_id", "left").withColumn("inferred", gate.inferred(F.col("mem_type"), F.col("source")))
        r = r.withColumn("op", gate.operation(F.lit(None).cast("string"), F.col("mem_type"), F.col("similar_id"))).withColumn("sensitivity", gate.sensitivity(F.lit(None).cast("string"), F.concat_ws("\n", "title", "body")))
        return r.withColumns({"target_id": F.when(F.col("op") == "update", F.col("similar_id")), "confidence": gate.confidence(F.col("confidence"), F.lit(None).cast("double"), F.col("inferred")), "needs_approval": gate.needs_approval(F.lit(False), F.col("domain"), F.col("sensitivity"), F.col("op"), F.col("inferred"))}).drop("similar_id", "inferred")

    def memory_ingest(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        return gate.ingested(batch)

    def memory_gate_audit(self, rejected: DataFrame) -> DataFrame:
        """The chained audit rows of requests (request_id, reject_reason) that the gate turned away."""
        return self._chained(rejected.select("request_id", F.lit("memory-gate").alias("run_id"), F.lit("rejected").alias("kind"), F.col("reject_reason").alias("summary")), "request_id")

    def memory_import_document(self, raw: DataFrame) -> DataFrame:
        return imports.imported(raw)

    def memory_import_candidates(self, raw: DataFrame) -> DataFrame:
        good = imports.extracted(raw).where("refusal IS NULL AND quality_status = 'passed'")
        return documents.candidates(good.select("id", "title", "text"), "id", "title", "text")

    def memory_document_imports_list(self, domain: str | None = None) -> DataFrame:
        rows = self["imports"] if domain is None else self["imports"].where(F.col("domain") == domain)
        return rows.orderBy(F.desc("created_on"), "id").limit(100)

    def memory_document_source_read(self, import_id: int) -> DataFrame:
        return self["imports"].where(F.col("id") == import_id).select("id", "content")

    def memory_proposals_list(self, status: str | None = None) -> DataFrame:
        if status is not None and status not in dims.PROPOSAL_STATUSES:
            raise ValueError(f"unknown status {status}")
        rows = self["proposals"] if status is None else self["proposals"].where(F.col("status") == status)
        return rows.orderBy(F.desc("created_on"), "id")

    def memory_proposals_decide(self, decisions: DataFrame) -> dict[str, DataFrame]:
        """Proposals and memories after decisions (id, approve, at). What is approved is applied; a proposal whose memory has
        changed since stays pending, and the memory as it is."""
        after = gate.decided(self["proposals"], decisions)
        now = after.where("status = 'approved'").join(self["proposals"].where("status = 'pending'").select("id"), "id", "left_semi")
        made = now.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), "op", "target_id", "base_hash", "domain", "mem_type", "title", "body", "valid_from")
        memories = gate.applied(self["memories"], made, self.as_of)
        conflict = now.join(memories.where("outcome = 'conflict'").select(F.col("id").alias("target_id")), "target_id", "left_semi").select("id", F.lit(True).alias("again"))
        status = F.when(F.col("again"), "pending").otherwise(F.col("status"))
        return {"proposals": after.join(conflict, "id", "left").withColumn("status", status).drop("again"), "memories": memories}

    def memory_confirm(self, ids: list[str]) -> DataFrame:
        return lifecycle.confirmed(self["memories"], ids, self.as_of)

    def memory_reindex(self, files: DataFrame) -> DataFrame:
        """Counts from files (id, content_hash) against the index."""
        return lifecycle.reindexed(files, self["memories"].select("id", F.sha2("body", 256).alias("content_hash")))

    def memory_maintenance_run(self) -> DataFrame:
        return lifecycle.maintained(self["memories"], self.as_of)

    def skills_distill(self) -> DataFrame:
        """A pending skill proposal for each completed task: what its trace tells, or its planned steps."""
        return gate.distilled(events.skill_steps(self["audit"], self["tasks"], self["task_steps"]), self["tasks"])

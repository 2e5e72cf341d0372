"""Agent events: classification of JSON lines, task state from the log, outcomes, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions import text


def _json(line: Column, path: str) -> Column:
    return F.get_json_object(line, path)


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` with event_kind, audit_kind, summary and tokens; what is not JSON is kept as a raw message.

    A line is parsed once to a struct; the order of the cases matters.
    """
    shape = "type string, thread_id string, message string, command string, error struct<message:string>, item struct<type:string,text:string,command:string,exit_code:bigint>, usage struct<input_tokens:bigint,output_tokens:bigint>, total_tokens bigint, tokens bigint, output_tokens bigint, input_tokens bigint"
    rows = lines.withColumn("line", text.trimmed(F.col("line"))).where("line <> ''").withColumn("is_json", F.try_parse_json("line").isNotNull())
    rows = rows.withColumn("j", F.when(F.col("is_json"), F.from_json("line", shape)))
    kind = F.coalesce("j.type", F.lit("unknown"))
    rows = rows.withColumn("t", kind)
    item = F.coalesce("j.item.type", F.lit("unknown"))
    holds = lambda *words: text.any_of(F.col("t"), words)
    is_item, tool = F.startswith("t", F.lit("item.")), holds("item", "command", "exec", "patch", "file")
    failed, counts = F.col("t").isin("turn.failed", "error"), holds("token", "usage")
    command = text.truncated(F.coalesce("j.item.command", F.lit("(command)")), 200)
    said = F.coalesce("j.message", F.concat(F.lit("$ "), F.col("j.command")), F.concat(F.lit("["), F.col("t"), F.lit("]")))
    of_item = (
        F.when(item == "agent_message", text.truncated(F.coalesce("j.item.text", F.lit("(empty agent message)")), 300))
        .when((item == "command_execution") & (F.col("t") == "item.completed") & F.col("j.item.exit_code").isNotNull(), F.concat(F.lit("$ "), command, F.lit(" (exit "), F.col("j.item.exit_code").cast("string"), F.lit(")")))
        .when(item == "command_execution", F.concat(F.lit("$ "), command))
        .otherwise(F.concat(F.lit("["), F.col("t"), F.lit("] "), item))
    )

    def ladder(raw, started, turn, done, failure, message, other_item, tools, usage, rest):
        return (
            F.when(~F.col("is_json"), raw).when(F.col("t") == "thread.started", started).when(F.col("t") == "turn.started", turn).when(F.col("t") == "turn.completed", done)
            .when(failed, failure).when(is_item & (item == "agent_message"), message).when(is_item, other_item).when(tool, tools).when(counts, usage).otherwise(rest)
        )

    lit = F.lit
    spent = F.coalesce("j.usage.input_tokens", lit(0)) + F.coalesce("j.usage.output_tokens", lit(0))
    counted = F.coalesce("j.total_tokens", "j.tokens", "j.output_tokens", "j.input_tokens")
    return rows.select(
        *(c for c in lines.columns),
        ladder(*map(lit, ("agent_message", "agent_message", "step_started", "step_completed", "error", "agent_message", "tool_call", "tool_call", "cost_update", "agent_message"))).alias("event_kind"),
        ladder(*map(lit, ("output", "context", "model_call", "model_call", "output", "output", "tool_call", "tool_call", "model_call", "model_call"))).alias("audit_kind"),
        ladder(F.col("line"), lit("Session started"), lit("Turn started"), lit("Turn completed"), F.coalesce("j.error.message", "j.message", lit("Task failed")), of_item, of_item, said, lit("Token usage update"), said).alias("summary"),
        F.when(F.col("is_json") & (F.col("t") == "turn.completed") & (spent > 0), spent).when(F.col("is_json") & ~failed & ~is_item & ~tool & counts & ~F.col("t").isin("thread.started", "turn.started", "turn.completed"), counted).alias("tokens"),
    )


def token_accounts(events: DataFrame) -> DataFrame:
    """Tokens of each task, from its classified events."""
    return events.groupBy("task_id").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def turn_results(lines: DataFrame) -> DataFrame:
    """Last message, last usage and last failure of each task's lines."""
    get = lambda p: _json(F.col("line"), p)
    kind = get("$.type")
    usage = F.coalesce(get("$.usage.input_tokens").try_cast("bigint"), F.lit(0)) + F.coalesce(get("$.usage.output_tokens").try_cast("bigint"), F.lit(0))
    r = lines.select(
        "task_id",
        "seq",
        F.when((kind == "item.completed") & (get("$.item.type") == "agent_message"), get("$.item.text")).alias("message"),
        F.when(kind == "turn.completed", usage).alias("usage"),
        F.when(kind.isin("turn.failed", "error"), F.coalesce(get("$.error.message"), get("$.message"))).alias("failure"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return r.groupBy("task_id").agg(last("message"), last("usage"), last("failure"))


def outcomes(lines: DataFrame, most: int = 8000) -> DataFrame:
    """All messages of a task in order, the last 8000 characters; a fixed sentence where there is none."""
    line = text.trimmed(F.col("line"))
    is_json = F.try_parse_json(line).isNotNull()
    kind = _json(line, "$.type")
    message = F.when(~is_json, line).when(kind.isin("thread.started") | ((_json(line, "$.item.type") == "agent_message") & F.startswith(kind, F.lit("item."))), F.coalesce(_json(line, "$.item.text"), _json(line, "$.message")))
    rows = lines.select("task_id", "seq", message.alias("m")).groupBy("task_id").agg(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("seq", "m")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda y: y["m"]), "\n\n")
    return rows.select("task_id", F.when(F.trim(joined) == "", "Task completed successfully.").otherwise(F.right(joined, F.lit(most))).alias("outcome"))


def final_status(events: DataFrame, exits: DataFrame) -> DataFrame:
    """Failed after any failure event or a non-zero exit code, else completed."""
    bad = events.groupBy("task_id").agg(F.bool_or(F.col("event_kind") == "error").alias("bad"))
    return bad.join(exits, "task_id", "left").select("task_id", F.when(F.col("bad") | (F.coalesce("exit_code", F.lit(0)) != 0), "failed").otherwise("completed").alias("status"))


def latest_state(changes: DataFrame) -> DataFrame:
    """State of each task from its log of changes (task_id, seq, status, step, tokens): last status and step, all tokens."""
    return changes.groupBy("task_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), F.max_by("step", F.when(F.col("step").isNotNull(), F.col("seq"))).alias("step"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("seq").alias("last_seq")
    )


def task_detail(tasks: DataFrame, steps: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks with their steps in order and their last event number."""
    s = steps.groupBy(F.col("task_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("step_index", "title"))).alias("steps"))
    e = events.groupBy(F.col("task_id").alias("id")).agg(F.max("seq").alias("last_seq"))
    return tasks.join(s, "id", "left").join(e, "id", "left").withColumn("last_seq", F.coalesce("last_seq", F.lit(0)))


def default_steps(tasks: DataFrame) -> DataFrame:
    """The three steps with which a task begins."""
    return tasks.select(F.col("id").alias("task_id"), F.posexplode(F.array(*map(F.lit, ("Plan", "Execute", "Verify")))).alias("step_index", "title"))


def approval_effects(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tasks after decisions (task_id, approve, reason): approved ones are planned, denied ones cancelled."""
    d = decisions.select(F.col("task_id").alias("id"), "approve", "reason")
    state = F.when(F.col("approve"), "planned").when(~F.col("approve"), "cancelled").otherwise(F.col("status"))
    return tasks.join(d, "id", "left").select("id", state.alias("status"), F.when(~F.col("approve"), F.coalesce("reason", F.lit("Denied"))).alias("failure"))


def trace_steps(audit: DataFrame, most: int = 25) -> DataFrame:
    """The first 25 telling steps of each run."""
    rows = audit.where("kind IN ('tool_call', 'approval', 'output') AND trim(summary) <> ''").withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("id")))
    return rows.where(F.col("n") <= most).select("run_id", "id", "summary")


def skill_steps(audit: DataFrame, tasks: DataFrame, task_steps: DataFrame, most: int = 25) -> DataFrame:
    """(task_id, ord, summary): what each completed task did, from its trace, or its planned steps (task_id, step_index, title)
    where the trace tells nothing. Tasks in any other state have none. The run of a task is named by its number."""
    done = tasks.where("status = 'completed'").select(F.col("id").alias("task_id"))
    traced = trace_steps(audit, most).select(F.col("run_id").try_cast("bigint").alias("task_id"), F.col("id").alias("ord"), "summary").join(done, "task_id", "left_semi")
    silent = done.join(traced.select("task_id").distinct(), "task_id", "left_anti")
    planned = task_steps.join(silent, "task_id", "left_semi").select("task_id", F.col("step_index").cast("bigint").alias("ord"), F.col("title").alias("summary"))
    return traced.unionByName(planned)


def tail(events: DataFrame, most: int = 2000) -> DataFrame:
    """The last ``most`` events of each task, each number once (-1 as often as it comes)."""
    w = Window.partitionBy("task_id", "seq").orderBy("arrival")
    once = events.withColumn("k", F.row_number().over(w)).where("k = 1 OR seq = -1").drop("k")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("arrival")))).where(F.col("k") <= most).drop("k")


def log_line(payload: Column) -> Column:
    """What a live log shows of an event: raw line, message, command, status, or the payload cut to 160 characters."""
    return F.coalesce(_json(payload, "$.raw_line"), _json(payload, "$.message"), _json(payload, "$.command"), _json(payload, "$.status"), text.truncated(payload, 160))


def diff_kind(line: Column) -> Column:
    return F.when(line.rlike(r"\A(\+\+\+|---)"), "file").when(F.startswith(line, F.lit("@@")), "hunk").when(F.startswith(line, F.lit("+")), "added").when(F.startswith(line, F.lit("-")), "removed").otherwise("same")

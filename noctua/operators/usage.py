"""Usage rollups, task lists, control figures: grouped, conditional and scalar aggregates over telemetry and tasks.

All take the time they look from. One pass over the input each, partial aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctua.functions import dims


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def token_total(threads: DataFrame) -> DataFrame:
    return threads.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens"))


def thread_counts(threads: DataFrame) -> DataFrame:
    return threads.agg(F.count("*").alias("threads"), F.count_if(F.col("archived") == 0).alias("active"))


def workspace_count(threads: DataFrame) -> DataFrame:
    return threads.agg(F.count_distinct("cwd").alias("workspaces"))


def top_workspaces(threads: DataFrame, limit: int = 6) -> DataFrame:
    """Workspaces with most tokens, the latest first among equals."""
    return (
        threads.groupBy("cwd")
        .agg(F.count("*").alias("threads"), F.sum("tokens_used").alias("tokens"), F.max(millis()).alias("last_ms"))
        .orderBy(F.desc("tokens"), F.desc("last_ms"), "cwd")
        .limit(limit)
    )


def millis() -> Column:
    return F.coalesce("updated_at_ms", F.col("updated_at") * 1000)


def trend(threads: DataFrame, now_s: int, days: int = 6) -> DataFrame:
    """Threads and tokens of each calendar day (UTC) in a rolling window; days without any are absent."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(updated_at div 86400 as int)"))
    return threads.where(F.col("updated_at") >= now_s - days * 86400).groupBy(day.alias("day")).agg(F.count("*").alias("threads"), F.sum("tokens_used").alias("tokens")).select(F.date_format("day", "MM-dd").alias("label"), "threads", "tokens")


def recent_logs(logs: DataFrame, now_s: int) -> DataFrame:
    return logs.where(F.col("updated_at") >= now_s - 86400).agg(F.count("*").alias("logs"))


def recent_workspaces(threads: DataFrame, limit: int = 24) -> DataFrame:
    return threads.where("cwd <> ''").groupBy("cwd").agg(F.max(millis()).alias("last_ms")).orderBy(F.desc("last_ms"), "cwd").limit(limit)


def recent_threads(threads: DataFrame, limit: int = 8) -> DataFrame:
    """The latest threads; an empty model name is none."""
    return threads.select("id", "title", "cwd", millis().alias("at_ms"), F.nullif("model", F.lit("")).alias("model")).orderBy(F.desc("at_ms"), "id").limit(limit)


def spent_on(tasks: DataFrame, day: str) -> DataFrame:
    return tasks.where(F.col("updated_on") == _day(day)).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 2).alias("spent"))


def by_domain(tasks: DataFrame) -> DataFrame:
    cost = F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 2)
    return tasks.groupBy("domain").agg(F.count("*").alias("runs"), F.sum("tokens").alias("tokens"), cost.alias("cost_usd"))


def active_count(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin(*dims.ACTIVE_STATUSES)).agg(F.count("*").alias("running"))


def header_metrics(tasks: DataFrame, day: str) -> DataFrame:
    today = F.col("updated_on") == _day(day)
    return tasks.agg(
        F.count_if(F.col("status").isin(*dims.ACTIVE_STATUSES)).alias("running"),
        F.count_if(F.col("status") == "waiting_for_approval").alias("waiting"),
        F.count_if((F.col("status") == "completed") & today).alias("completed_today"),
        F.round(F.coalesce(F.sum(F.when(today, F.col("cost_usd"))), F.lit(0.0)), 2).alias("spent_today"),
    )


def control_status(tasks: DataFrame, approvals: DataFrame, proposals: DataFrame, day: str) -> DataFrame:
    """One row from four one-row aggregates."""
    out = approvals.agg(F.count_if(F.col("status") == "pending").alias("pending_approvals"))
    out = out.crossJoin(proposals.agg(F.count_if(F.col("status") == "pending").alias("pending_proposals")))
    return out.crossJoin(active_count(tasks)).crossJoin(spent_on(tasks, day).withColumnRenamed("spent", "spent_today"))


def import_status(imports: DataFrame, proposals: DataFrame) -> DataFrame:
    """Status of each import from its proposals."""
    n = proposals.groupBy("import_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"))
    joined = imports.select(F.col("id").alias("import_id")).join(n, "import_id", "left")
    state = F.when(F.coalesce("total", F.lit(0)) == 0, "no_candidates").when(F.col("pending") == F.col("total"), "pending").when(F.col("pending") > 0, "partial").otherwise("completed")
    return joined.select("import_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("pending", F.lit(0)).alias("pending"), state.alias("status"))


def status_rank(status: Column) -> Column:
    """Waiting for approval 0, active 1, queued 2, ended 3."""
    return F.when(status == "waiting_for_approval", 0).when(status.isin(*dims.ACTIVE_STATUSES), 1).when(status.isin(*dims.TERMINAL_STATUSES), 3).otherwise(2)


def task_order(tasks: DataFrame, limit: int) -> DataFrame:
    ranked = tasks.withColumn("rank", status_rank(F.col("status")))
    return ranked.orderBy("rank", F.desc("updated_on"), "id").select("id", "status", "rank", "updated_on").limit(limit)


def rollup(tasks: DataFrame) -> DataFrame:
    """Runs, tokens and cost per month and domain (an extension: specified, not built, in the model's source)."""
    return tasks.groupBy(F.trunc("updated_on", "month").alias("period"), "domain").agg(F.count("*").alias("runs"), F.sum("tokens").alias("tokens"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 2).alias("cost_usd"))

"""Admission of new memories: scans, ordered gates, near-duplicates of titles, routing, versioned application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctua.functions import dims, text
from noctua.operators import pairs
from noctua.sources.tables import stored

SIMILAR, POOL = 0.82, 10


def has_secret(c: Column) -> Column:
    """Whether a text holds what looks like a credential, once placeholders of documentation are put aside."""
    for p in dims.PLACEHOLDERS:
        c = F.replace(c, F.lit(p), F.lit("<documentation-placeholder>"))
    c = F.regexp_replace(c, dims.BEARER_PROSE, "bearer <token-description>")
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in dims.SECRETS))


def has_injection(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in dims.INJECTIONS))


def sensitivity(suggested: Column, c: Column) -> Column:
    """``sensitive`` if suggested so or if the text names a sensitive matter; an unknown suggestion is an error."""
    known = F.when(suggested.isNotNull() & ~suggested.isin("normal", "sensitive"), F.raise_error(F.lit("invalid sensitivity")).cast("string"))
    return F.coalesce(known, F.when((suggested == "sensitive") | c.rlike(dims.SENSITIVE), "sensitive").otherwise("normal"))


def lifecycle_error(valid_from: Column, valid_until: Column, expires: Column, stale_after: Column, confidence: Column) -> Column:
    """What is wrong with the dates and limits of a request; null if nothing."""
    bad = lambda c: c.isNotNull() & text.first_date(c).isNull()
    return (
        F.when(bad(valid_from) | bad(valid_until) | bad(expires), "date")
        .when(text.first_date(valid_from) > text.first_date(valid_until), "order")
        .when(~stale_after.between(1, 36_500), "stale_after_days")
        .when(F.isnan(confidence) | ~confidence.between(0.0, 1.0), "confidence")
    )


def checks() -> list[tuple[str, Column]]:
    """The gates in order, each with the condition under which it rejects."""
    both = F.concat_ws("\n", "title", "body")
    c = F.col
    return [
        ("type", c("mem_type").isNull() | ~c("mem_type").isin(*dims.MEM_TYPES)),
        ("domain", c("domain").isNull() | ~c("domain").isin(*dims.DOMAINS)),
        ("title", ~F.coalesce(F.length(F.trim("title")), F.lit(0)).between(1, 200) | (F.coalesce(F.trim("body"), F.lit("")) == "")),
        ("lifecycle", lifecycle_error(c("valid_from"), c("valid_until"), c("expires"), c("stale_after_days"), c("confidence")).isNotNull()),
        ("secrets", has_secret(both)),
        ("injection", has_injection(both)),
        ("body_length", c("mem_type").isin(*dims.SHORT_BODY_TYPES) & (F.length("body") > dims.SHORT_BODY)),
        ("provenance", ~((c("source") == "manual") | F.contains("source", F.lit(":")))),
    ]


def judged(requests: DataFrame) -> DataFrame:
    """``requests`` with ``reject_reason``, the first gate that fails (null: admitted), and ``report`` of all gates up to it."""
    failed = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks())), lambda x: x.isNotNull())
    out = requests.withColumn("reject_reason", F.try_element_at(failed, F.lit(1)))
    names = F.array(*(F.lit(name) for name, _ in checks()))
    seen = F.when(F.col("reject_reason").isNull(), names).otherwise(F.slice(names, 1, F.array_position(names, F.col("reject_reason")).cast("int")))
    return out.withColumn("report", F.transform(seen, lambda n: F.struct(n.alias("gate"), (~F.coalesce(n == F.col("reject_reason"), F.lit(False))).alias("passed"))))


def similar_titles(requests: DataFrame, memories: DataFrame, key: str = "request_id", part: int = pairs.PART) -> DataFrame:
    """(key, memory_id, score): the live memory of the same domain whose title is most like the request's, if alike enough;
    of equals the one of greatest id. A title without terms is like none.

    Titles of equal terms are one class on either side, and a class that the other side has too needs no comparison. Other
    classes meet only by their rarest terms: a pair as similar as asked shares one of the first few in order of frequency,
    and the places of that term bound what both can share. Terms of many classes are cut into cells of bounded size.
    """

    def classes(rows: DataFrame, title: str, ident: str) -> DataFrame:
        terms = rows.select(F.col(ident), "domain", F.array_sort(text.term_set(F.col(title), 2)).alias("terms")).where(F.size("terms") > 0)
        return terms.withColumn("set", F.sha2(F.array_join("terms", " "), 256))

    # stored, so that the texts that titles come from are read once for each side and not by every later step
    own = stored(classes(requests, "title", key), "titles-asked")
    m = stored(classes(memories.where("status <> 'expired'"), "title", "id"), "titles-held").groupBy("domain", "set").agg(F.max("id").alias("memory_id"), F.first("terms").alias("terms"))
    r = own.groupBy("domain", "set").agg(F.first("terms").alias("own"))
    same = r.join(m, ["domain", "set"]).select("domain", "set", "memory_id", F.lit(1.0).alias("score"))
    r = r.join(m, ["domain", "set"], "left_anti")
    each = m.select("memory_id", "domain", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    freq = each.groupBy("domain", "term").agg(F.count("*").alias("df"))
    asked = r.select("set", "domain", F.size("own").alias("n"), F.struct("domain", "set").alias("class"), F.explode("own").alias("term"))
    on = ["domain", "term"]
    left = pairs.prefixed(asked, "class", on, freq, SIMILAR).select(*on, "set", F.col("n").alias("na"), F.col("k").alias("ka"))
    right = pairs.prefixed(each, "memory_id", on, freq, SIMILAR).select(*on, "memory_id", F.col("n").alias("nb"), F.col("k").alias("kb"))
    reach = pairs.may_reach(*map(F.col, ("na", "ka", "nb", "kb")), SIMILAR)
    may = pairs.met(left, right, on, "set", "memory_id", reach, part).select("domain", "set", "memory_id").distinct()
    alike = may.join(r, ["domain", "set"]).join(m.select("memory_id", "terms"), "memory_id").withColumn("score", text.similarity(F.col("own"), F.col("terms"))).where(F.col("score") >= SIMILAR)
    best = alike.groupBy("domain", "set").agg(F.max(F.struct("score", "memory_id")).alias("b")).select("domain", "set", "b.memory_id", "b.score")
    return own.join(best.unionByName(same), ["domain", "set"]).select(key, "memory_id", "score")


def operation(supersedes: Column, mem_type: Column, similar: Column) -> Column:
    return F.when(supersedes.isNotNull(), "supersede").when(mem_type == "episode", "create").when(similar.isNotNull(), "update").otherwise("create")


def inferred(mem_type: Column, source: Column) -> Column:
    return (mem_type == "preference") & (source != "manual") & ~F.startswith(source, F.lit("meeting:"))


def confidence(asked: Column, old: Column, is_inferred: Column) -> Column:
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(asked, old, F.lit(0.8))))
    return F.when(is_inferred, F.least(value, F.lit(0.5))).otherwise(value)


def needs_approval(forced: Column, domain: Column, level: Column, op: Column, is_inferred: Column) -> Column:
    return forced | ~domain.isin(*dims.AUTO_APPLY_DOMAINS) | (level == "sensitive") | (op == "supersede") | is_inferred


def merged_body(old: Column, new: Column, mem_type: Column) -> Column:
    """Old and new wording of an updated memory."""
    old, new = F.trim(old), F.trim(new)
    both = F.concat(old, F.lit("\n\nUpdate:\n"), new)
    short = mem_type.isin(*dims.SHORT_BODY_TYPES) & (F.length(both) > dims.SHORT_BODY)
    return F.when(F.contains(old, new), old).when(F.contains(new, old), new).when(short, new).otherwise(both)


def applied(memories: DataFrame, proposals: DataFrame, as_of: str) -> DataFrame:
    """Memories after proposals (id of its own, op, target_id, base_hash, title, body, …) were applied, with ``outcome``.

    An update or supersede of a memory whose content has changed since leaves it as it is (outcome ``conflict``). A
    superseded memory stays as a stale version whose validity ends; its successor is a row of its own.
    """
    p = proposals.select(*(F.col(c).alias(f"p_{c}") for c in proposals.columns))
    hit = memories.join(p.where("p_op IN ('update', 'supersede')"), memories.id == F.col("p_target_id"), "left")
    fresh = F.col("p_base_hash") == F.sha2("body", 256)
    update, closed = (F.col("p_op") == "update") & fresh, (F.col("p_op") == "supersede") & fresh
    day = F.coalesce("p_valid_from", F.lit(as_of))
    changed = hit.select(
        "id", "domain", "mem_type", "title",
        F.when(update, merged_body(F.col("body"), F.col("p_body"), F.col("mem_type"))).otherwise(F.col("body")).alias("body"),
        F.when(update, F.col("confirmation_count") + 1).otherwise(F.col("confirmation_count")).alias("confirmation_count"),
        F.when(closed, "stale").when(update, "active").otherwise(F.col("status")).alias("status"),
        F.when(closed, day).alias("valid_until"),
        F.when(F.col("p_op").isNull(), "kept").when(~fresh, "conflict").when(update, "updated").otherwise("superseded").alias("outcome"),
    )
    superseded = changed.where("outcome = 'superseded'").select(F.col("id").alias("p_target_id"))
    new = p.where("p_op = 'create'").unionByName(p.where("p_op = 'supersede'").join(superseded, "p_target_id", "left_semi").select(*p.columns))
    made = new.select(
        F.col("p_id").alias("id"), F.col("p_domain").alias("domain"), F.col("p_mem_type").alias("mem_type"), F.col("p_title").alias("title"), F.col("p_body").alias("body"),
        F.lit(1).cast(changed.schema["confirmation_count"].dataType).alias("confirmation_count"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("valid_until"), F.lit("created").alias("outcome"),
    )
    return changed.unionByName(made)


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals after decisions (id, approve): only pending ones change."""
    d = decisions.groupBy("id").agg(F.max_by("approve", "at").alias("approve"))
    state = F.when((F.col("status") == "pending") & F.col("approve"), "approved").when((F.col("status") == "pending") & ~F.col("approve"), "discarded").otherwise(F.col("status"))
    return proposals.join(d, "id", "left").withColumn("status", state).drop("approve")


def ingested(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of one to ten candidates of one source, as (admitted, rejected): a bad row doesn't stop the others."""
    n = batch.limit(11).count()
    if not 1 <= n <= 10:
        raise ValueError("a batch has one to ten candidates")
    out = judged(batch.withColumn("source", F.when(F.contains("source", F.lit(":")), F.col("source")).otherwise(F.lit(""))))
    return out.where("reject_reason IS NULL"), out.where("reject_reason IS NOT NULL")


def captured(tasks: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Episodes from the outcomes (id, outcome) of completed runs in the domains that keep them; they expire in 30 days."""
    rows = tasks.where(F.col("domain").isin(*dims.AUTO_APPLY_DOMAINS) & (F.col("status") == "completed")).join(outcomes, "id")
    return rows.select(
        F.concat(F.lit("run:"), F.col("id").cast("string")).alias("source"), "domain", F.lit("episode").alias("mem_type"), "title",
        F.concat(F.lit("Goal: "), F.col("goal"), F.lit("\n\nOutcome: "), F.col("outcome")).alias("body"), F.date_add(F.lit(as_of).cast("date"), dims.CAPTURE_TTL).cast("string").alias("expires"),
    )


def distilled(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """A skill proposal for each completed task from its steps (task_id, ord, summary), none of which may be there; it always
    waits for approval."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["summary"]))
    body = steps.groupBy(F.col("task_id").alias("id")).agg(F.array_join(lines, "\n").alias("body"))
    return tasks.where("status = 'completed'").select("id", "title", "domain").join(body, "id", "left").select(F.col("id").alias("task_id"), "title", "domain", F.coalesce("body", F.lit("")).alias("body"), F.lit("pending").alias("status"), F.lit(True).alias("requires_approval"))


def goal_policy(goal: Column) -> tuple[Column, Column, Column]:
    """(risk level, needs approval, sandbox) of a goal, by words it holds, even inside others."""
    low = F.lower(goal)
    level = F.when(text.any_of(low, dims.HIGH_RISK), "high").when(text.any_of(low, dims.MEDIUM_RISK), "medium").otherwise("low")
    return level, level != "low", F.when(level == "low", "read-only").otherwise("workspace-write")

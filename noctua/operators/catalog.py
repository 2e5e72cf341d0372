"""The catalog of agents, skills and tools: classification of manifests, merging, filtering, workspace roots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions import dims, text

_OPTIONAL, _RICH = ("summary", "version", "category", "entrypoint"), ("origin", "group")


def _first_signal(low: Column, signals) -> Column:
    return F.coalesce(*(F.when(text.any_of(low, words), name) for name, words in signals))


def manifest_kind(words: Column) -> Column:
    """Kind of a package manifest by what its dependencies and scripts mention; null if nothing does."""
    return _first_signal(text.ascii_lower(words), dims.KIND_SIGNALS)


def python_kind(words: Column, has_crewai: Column) -> Column:
    """Kind of a Python project."""
    low = text.ascii_lower(words)
    signals = [s for s in dims.KIND_SIGNALS if s[1][0] in ("workflow", "agent", "automation")]
    return F.when(has_crewai, "agent").otherwise(_first_signal(low, signals))


def is_mcp(words: Column) -> Column:
    return text.any_of(text.ascii_lower(words), dims.MCP_SIGNALS)


def provider(words: Column) -> Column:
    return F.coalesce(_first_signal(text.ascii_lower(words), dims.PROVIDER_SIGNALS), F.lit("local"))


def preferred_provider(one: Column, other: Column) -> Column:
    return F.when((one == "local") & (other != "local"), other).otherwise(one)


def manifest_tags(words: Column) -> Column:
    low = text.ascii_lower(words)
    found = F.filter(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in dims.MANIFEST_TAGS)), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("manifest"))).otherwise(found)


def relevant_script(scripts: Column) -> Column:
    """``name: command`` of the script that the list of words names first; of several for a word, the first by name."""
    entries = F.array_sort(F.map_entries(scripts))
    hit = lambda k: F.filter(entries, lambda e: F.contains(text.ascii_lower(e["key"]), F.lit(k)) | F.contains(text.ascii_lower(e["value"]), F.lit(k)))
    first = F.coalesce(*(F.try_element_at(hit(k), F.lit(1)) for k in dims.SCRIPT_PRIORITY))
    return F.concat(first["key"], F.lit(": "), first["value"])


def extension(path: Column) -> Column:
    """What follows the last dot of a file name that does not begin there; null without."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(name, r"\A.+\.([^.]*)\z", 1), F.lit(""))


def supported_file(path: Column, kind: Column) -> Column:
    ext = extension(path)
    rules = [(kind == k) & ext.isin(*v) for k, v in dims.KIND_EXTENSIONS.items()]
    return F.coalesce(reduce(lambda a, b: a | b, rules) | ((kind == "skill") & (F.element_at(F.split(path, "/"), -1) == "SKILL.md")), F.lit(False))


def script_candidate(path: Column) -> Column:
    name = text.ascii_lower(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(extension(path).isin(*dims.SCRIPT_EXTENSIONS), F.lit(False)) & text.any_of(name, dims.SCRIPT_NAMES)


def script_signal(content: Column) -> Column:
    """Whether a script drives a browser or calls tools."""
    return text.any_of(text.ascii_lower(content), ("playwright", "puppeteer", "selenium", "tool_call", "tools="))


def display_path(path: Column, home: str) -> Column:
    return F.when(F.startswith(path, F.lit(home + "/")), F.concat(F.lit("~/"), F.substring(path, F.lit(len(home) + 2), F.length(path)))).otherwise(path)


def item_id(path: Column, home: str, name: Column) -> Column:
    return F.concat(display_path(path, home), F.lit("::"), text.catalog_slug(name))


def kind_rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in dims.KIND_RANK.items() for x in kv)), kind)


def kind_confidence(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in dims.KIND_CONFIDENCE.items() for x in kv)), kind)


def merged(items: DataFrame) -> DataFrame:
    """One row per id of items reported several times, as if folded in order of ``ord``.

    Of two, the one of higher confidence leads, or of lower kind rank among equals; its optional texts give way to
    longer ones (in bytes) of the other. A local provider gives way to a named one, tags are joined, dates and
    confidence take the greater.

    An item that leads all before it is a record. Then every field is an extreme: the last record's, the longest text's,
    on a tie the last record's of them or else the first, and so on. So one sorted pass finds the records and plain
    aggregates do the rest; no array of an id's reports is made, however many there are.
    """
    texts = [c for c in (*_OPTIONAL, *_RICH) if c in items.columns]
    rank = F.struct(F.col("confidence"), (-kind_rank(F.col("kind"))).alias("rank"))
    before = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(before))
    rows = rows.withColumn("_record", F.col("_best").isNull() | (F.col("_rank") > F.col("_best")))
    # the last record, else the first of the others
    late = F.struct(F.col("_record"), F.when(F.col("_record"), F.col("ord")).otherwise(-F.col("ord")))
    named = (F.col("provider") != "local").cast("int")
    aggregates = []
    for c in items.columns:
        if c in texts:
            aggregates.append(F.max_by(c, F.struct(F.coalesce(F.octet_length(c), F.lit(-1)), late)).alias(c))
        elif c == "provider":
            aggregates.append(F.max_by(c, F.struct(named, late)).alias(c))
        elif c in ("updated_at", "confidence"):
            aggregates.append(F.max(c).alias(c))
        elif c not in ("id", "ord", "tags"):
            aggregates.append(F.max_by(c, late).alias(c))
    # tags of records come first, the last record's before; then those of the others
    place = F.struct((~F.col("_record")).alias("other"), F.when(F.col("_record"), -F.col("ord")).otherwise(F.col("ord")).alias("at"), "i", "tag")
    each = rows.select("id", "_record", "ord", F.posexplode("tags").alias("i", "tag")).where(F.trim("tag") != "")
    each = each.groupBy("id", text.ascii_lower(F.col("tag")).alias("low")).agg(F.min(place).alias("x"))
    tags = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tag"]).alias("tags"))
    out = rows.groupBy("id").agg(*aggregates).join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.select("id", *(c for c in items.columns if c not in ("id", "ord")))


def ordered(items: DataFrame) -> DataFrame:
    return items.orderBy(kind_rank(F.col("kind")), "display_name", "id")


def counts(items: DataFrame) -> DataFrame:
    """Items of each of the eight kinds, zero where there is none, in one row."""
    return items.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in dims.KINDS))


def matching(items: DataFrame, kind: str, needle: str) -> DataFrame:
    words = F.lower(F.concat_ws(" ", "id", "display_name", "summary", "category", "provider", F.array_join("tags", " ")))
    return items.where((F.col("kind") == kind) & F.contains(words, F.lit(needle.strip().lower())))


def page(rows: DataFrame, order: list[str], number: int, size: int = 8) -> DataFrame:
    """Page ``number`` (from 1) of rows; beyond the last page it is the last."""
    last = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def workspace(path: Column, home: str) -> Column:
    """Whether a path may be a workspace: absolute, two levels under home, not in a tool's own folder or an app bundle."""
    vendor = [F.startswith(F.concat(path, F.lit("/")), F.lit(f"{home}/.{v}/")) for v in ("codex", "claude", "gemini", "n8n")]
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return F.startswith(path, F.lit("/")) & (path != "/") & ~reduce(lambda a, b: a | b, vendor) & ~path.rlike(r"\.app(/|\z)") & (depth - len([p for p in home.split("/") if p]) >= 2)


def roots(lanes: list[DataFrame], home: str, most: int = 24) -> DataFrame:
    """Workspace roots from several sources, in their order, each path once, at most 24."""
    rows = reduce(lambda a, b: a.unionByName(b), (x.select("path", F.col("ord").cast("bigint").alias("ord"), F.lit(k).alias("lane")) for k, x in enumerate(lanes)))
    first = rows.where(workspace(F.col("path"), home)).groupBy("path").agg(F.min(F.struct("lane", "ord")).alias("at"))
    return first.orderBy("at", "path").limit(most).select("path")


def topmost(paths: DataFrame) -> DataFrame:
    """Paths without those that lie under another: each asks for its ancestors, an equi-join, not a comparison of all pairs."""
    one = paths.select("path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    asks = one.select("path", F.explode(above).alias("ancestor")).where("ancestor <> path AND ancestor <> ''")
    under = asks.join(one.withColumnRenamed("path", "ancestor"), "ancestor", "left_semi").select("path").distinct()
    return one.join(under, "path", "left_anti")


def instruction_items(files: DataFrame) -> DataFrame:
    """One item per topmost folder with instruction files (path of folder, name, summary): files in fixed order, the
    longest summary, provider ``multi`` if several."""
    order = F.create_map(*map(F.lit, ("AGENTS.md", 0, "CLAUDE.md", 1, "GEMINI.md", 2)))
    names = F.create_map(*map(F.lit, ("AGENTS.md", "local", "CLAUDE.md", "claude", "GEMINI.md", "gemini")))
    known = files.where(F.col("name").isin("AGENTS.md", "CLAUDE.md", "GEMINI.md"))
    rows = known.join(topmost(known.select("path")), "path", "left_semi").withColumn("k", F.element_at(order, F.col("name"))).withColumn("provider", F.element_at(names, F.col("name")))
    return rows.groupBy("path").agg(
        F.min_by("name", "k").alias("entrypoint"),
        F.max_by("summary", F.struct(F.octet_length("summary"), -F.col("k"))).alias("summary"),
        F.when(F.count_distinct("provider") > 1, "multi").otherwise(F.min("provider")).alias("provider"),
    )


def markdown_summary(content: Column) -> Column:
    """The first line of a markdown text that is neither frontmatter, heading nor blank."""
    body = F.regexp_replace(content, r"(?s)\A\s*---\s*\n.*?\n\s*---\s*(\n|\z)", "")
    lines = F.filter(F.transform(F.split(body, r"\n"), text.trimmed), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.try_element_at(lines, F.lit(1))


def skill_summary(content: Column) -> Column:
    """The description of a skill's frontmatter, else its first line."""
    front = F.regexp_extract(content, r"(?s)\A---\s*\n(.*?)\n\s*---", 1)
    said = F.regexp_extract(front, r"(?m)^\s*description:[ \t]*(.*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(text.trimmed(said), r'\A"+|"+\z', ""), F.lit("")), markdown_summary(content))


def script_summary(content: Column) -> Column:
    """The first telling line among the first sixteen of a script."""
    line = lambda x: text.trimmed(F.regexp_replace(F.regexp_replace(text.trimmed(x), r"\A/+", ""), r"\A#+", ""))
    lines = F.filter(F.transform(F.slice(F.split(content, r"\n"), 1, 16), line), lambda x: (F.octet_length(x) > 12) & ~F.startswith(x, F.lit("import ")) & ~F.startswith(x, F.lit("from ")))
    return F.try_element_at(lines, F.lit(1))


def folder_summary(files: DataFrame) -> DataFrame:
    """Summary of each folder from its files (folder, name, content): README, instruction files, skill, in that order."""
    order = F.create_map(*(F.lit(x) for k, n in enumerate(("README.md", "AGENTS.md", "CLAUDE.md", "GEMINI.md", "SKILL.md")) for x in (n, k)))
    said = F.when(F.col("name") == "SKILL.md", skill_summary(F.col("content"))).otherwise(markdown_summary(F.col("content")))
    rows = files.select("folder", F.element_at(order, F.col("name")).alias("k"), said.alias("said")).where("k IS NOT NULL AND said IS NOT NULL")
    return rows.groupBy("folder").agg(F.min_by("said", "k").alias("summary"))


ENTRYPOINTS = ("agent.py", "agent.ts", "agent.tsx", "main.py", "main.ts", "main.tsx", "index.js", "index.ts", "index.tsx", "workflow.json", "README.md")


def folder_entrypoint(files: DataFrame) -> DataFrame:
    order = F.create_map(*(F.lit(x) for k, n in enumerate(ENTRYPOINTS) for x in (n, k)))
    rows = files.select("folder", "name", F.element_at(order, F.col("name")).alias("k")).where("k IS NOT NULL")
    return rows.groupBy("folder").agg(F.min_by("name", "k").alias("entrypoint"))


def mcp_servers(configs: DataFrame, default_provider: str) -> DataFrame:
    """(path, server, entrypoint, provider, summary, tags) of the servers in configurations (path, content)."""
    shape = "mcpServers map<string,struct<url:string,command:string,type:string>>"
    rows = configs.select("path", F.explode(F.from_json("content", shape)["mcpServers"]).alias("server", "s"))
    point = F.coalesce(text.url_path(F.col("s.url")), F.col("s.command"))
    return rows.select(
        "path", "server", point.alias("entrypoint"), F.when(point.isNotNull(), provider(point)).otherwise(F.lit(default_provider)).alias("provider"),
        F.concat(F.lit("MCP server endpoint: "), point).alias("summary"), F.when(F.col("s.type").isNotNull(), F.array(F.lit("mcp"), F.col("s.type"))).otherwise(F.array(F.lit("mcp"))).alias("tags"),
    )

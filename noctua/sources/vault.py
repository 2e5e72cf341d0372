"""Markdown notes with YAML frontmatter: listing, reading, writing, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.functions import dims, text

REQUIRED = ("id", "type", "domain", "title", "created", "updated")
_NOTE = "path string, id string, mem_type string, domain string, title string, created_at string, updated_at string, confidence double, sensitivity string, tags array<string>, stale_after_days bigint, expires_at string, valid_from string, valid_until string, body string, error string"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the notes under the domain folders, without archives and hidden folders; paths from the root on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    path = F.regexp_replace("path", rf"\A[a-z]*:?/*{base}/", "")
    rows = files.select(path.alias("path"), F.col("content").cast("string").alias("content"))
    return rows.where(in_vault(F.col("path")))


def in_vault(path: Column) -> Column:
    """Whether a path from the root on lies under a domain folder, neither archived nor hidden."""
    parts = F.split(path, "/")
    return parts[0].isin(*dims.DOMAINS) & ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | (p == "_archive"))


def tree(files: DataFrame) -> DataFrame:
    """(path, parent, name, depth, is_dir): files and all folders above them, in order of path."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), (k < F.size(parts)).alias("is_dir")))
    rows = files.select(F.explode(ups).alias("n")).select("n.*").distinct()
    names = F.split("path", "/")
    return rows.select("path", F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), "/").alias("parent"), F.element_at(names, -1).alias("name"), F.size(names).alias("depth"), "is_dir").orderBy("path")


def body_of(content: Column) -> Column:
    """What follows the frontmatter; null for a text without one."""
    return F.when(content.rlike(r"(?s)\A---\r?\n.*?\r?\n---\r?(\n|\z)"), F.regexp_replace(content, r"(?s)\A---\r?\n.*?\r?\n---\r?(\n|\z)", ""))


def parsed(files: DataFrame) -> DataFrame:
    """Notes with their frontmatter as columns; ``error`` says what is missing or wrong, and null that nothing is.

    YAML needs a parser; it runs over batches. Times stay strings.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        class Plain(yaml.SafeLoader):
            pass

        Plain.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        for frame in frames:
            yield pd.DataFrame([_note(p, c, lambda s: yaml.load(s, Plain)) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=[x.split()[0] for x in _NOTE.split(", ")])

    return files.select("path", "content").mapInPandas(run, _NOTE)


def _note(path: str, content: str | None, load) -> tuple:
    bad = lambda why: (path, *[None] * 14, why)
    head, fence, body = _split(content or "")
    if not fence:
        return bad("no frontmatter")
    try:
        y = load(head)
    except Exception as x:  # a parser's errors are of many kinds
        return bad(f"yaml: {type(x).__name__}")
    if not isinstance(y, dict) or any(not y.get(k) for k in REQUIRED):
        return bad("missing " + ", ".join(k for k in REQUIRED if not (isinstance(y, dict) and y.get(k))))
    confidence = y.get("confidence", 0.7)
    if not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        return bad("confidence")
    if path.split("/")[0] != str(y["domain"]):
        return bad("domain differs from folder")
    opt = lambda k: None if y.get(k) is None else str(y[k])
    days = y.get("stale_after_days")
    return (path, str(y["id"]), str(y["type"]), str(y["domain"]), str(y["title"]), str(y["created"]), str(y["updated"]), float(confidence), opt("sensitivity") or "normal", [str(v) for v in y.get("tags") or []], None if days is None else int(days), opt("expires"), opt("valid_from"), opt("valid_until"), body, None)


def _split(content: str) -> tuple[str, bool, str]:
    normal = content.replace("\r\n", "\n")
    if not normal.startswith("---\n"):
        return "", False, content
    head, fence, body = normal[4:].partition("\n---")
    if not fence or (body and not body.startswith("\n")):
        return "", False, content
    return head, True, body.removeprefix("\n")


def rendered(notes: DataFrame) -> Column:
    """A note as a file's text: frontmatter in fixed order, then the body."""
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit("\n"))).otherwise("")
    quoted = F.concat(F.lit('"'), F.replace(F.replace("title", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    tags = F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]"))
    c = F.col
    return F.concat(
        F.lit("---\n"), line("id", c("id")), line("type", c("mem_type")), line("domain", c("domain")), line("title", quoted), line("created", c("created_at")), line("updated", c("updated_at")),
        line("confidence", c("confidence")), line("sensitivity", c("sensitivity")), line("stale_after_days", c("stale_after_days")), line("expires", c("expires_at")), line("valid_from", c("valid_from")),
        line("valid_until", c("valid_until")), line("tags", tags), F.lit("---\n"), c("body"),
    )


def index_rows(notes: DataFrame) -> DataFrame:
    """Index rows of notes: the first 280 characters as summary, the content's hash."""
    return notes.where("error IS NULL").select("id", F.col("path").alias("vault_path"), "domain", "mem_type", "title", F.left("body", F.lit(280)).alias("summary"), "confidence", F.sha2("body", 256).alias("content_hash"))


def source_snapshot(imports: DataFrame) -> DataFrame:
    """Immutable copies of imported texts (id, title, content): path, file text with a header, hash."""
    path = F.concat("domain", F.lit("/sources/"), text.import_slug(F.col("title")), F.lit("-"), F.left(F.sha2("content", 256), F.lit(8)), F.lit(".md"))
    head = F.concat(F.lit('---\nkind: source\nimport: "'), F.col("id").cast("string"), F.lit('"\nsha256: '), F.sha2("content", 256), F.lit("\n---\n"))
    return imports.select("id", path.alias("path"), F.concat(head, "content").alias("file"), F.sha2("content", 256).alias("content_hash"))

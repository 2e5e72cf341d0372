"""The life of a document import: text, quality, passages, candidates, proposals, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.functions import text
from noctua.operators import documents, gate

MOST_BYTES = 2 * 1024 * 1024


def extracted(raw: DataFrame) -> DataFrame:
    """(id, domain, title, text, refusal, quality_status): what each import (id, domain, title, input_kind, content) holds.

    Credentials refuse an import, injected instructions only warn; text of poor quality is kept but mined for nothing.
    """
    body = F.when(F.col("input_kind") == "url", text.html_to_text(F.col("content"))).otherwise(F.col("content"))
    rows = raw.select("id", "domain", "title", body.alias("text"))
    refusal = (
        F.when(F.coalesce(F.octet_length("text"), F.lit(0)) > MOST_BYTES, "too large").when(F.coalesce(text.trimmed(F.col("text")), F.lit("")) == "", "empty").when(gate.has_secret(F.col("text")), "secrets")
    )
    rows = rows.withColumn("refusal", refusal).withColumn("warning", F.when(gate.has_injection(F.col("text")), "injection"))
    rows = rows.withColumn("q", text.quality(F.col("text")))  # once; its figures are used several times
    return rows.withColumn("quality_status", F.when(text.quality_passed(F.col("q")), "passed").otherwise("failed")).drop("q")


def imported(raw: DataFrame) -> DataFrame:
    """One row per import: refusal, warning, quality, number of passages and of candidates, status.

    All of it is in the import's own row: one pass over the contents, without joins."""
    usable, own = F.col("refusal").isNull(), extracted(raw)
    counted = own.withColumn("chunks", F.when(usable, F.size(documents.passages(F.col("text")))).otherwise(0).cast("bigint"))
    found = documents.candidate_lists(counted.withColumn("text", F.when(usable & (F.col("quality_status") == "passed"), F.col("text"))), "title", "text")
    out = found.withColumn("candidates", F.size("candidates").cast("bigint"))
    return out.withColumn("status", F.when(F.col("refusal").isNotNull(), "rejected").when(F.col("candidates") == 0, "no_candidates").otherwise("pending"))

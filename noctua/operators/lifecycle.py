"""Time-driven changes of memories, and the comparison of files with the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.functions import dims, text


def expired(memories: DataFrame, as_of: str) -> DataFrame:
    """Episodes whose expiry date lies before ``as_of`` become expired and move to the archive; others stay."""
    over = (F.col("mem_type") == "episode") & F.col("expires_at").isNotNull() & (F.left("expires_at", F.lit(10)) < as_of) & (F.col("status") != "expired")
    path = F.concat(F.lit("_archive/"), "domain", F.lit("/episodes/"), F.element_at(F.split("vault_path", "/"), -1))
    return memories.withColumn("vault_path", F.when(over, path).otherwise(F.col("vault_path"))).withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def staled(memories: DataFrame, as_of: str) -> DataFrame:
    """Active facts, entities and preferences that nothing has confirmed for longer than they may go become stale."""
    since = F.coalesce("last_confirmed_at", F.nullif("updated_at", F.lit("")), "created_at")
    over = F.col("mem_type").isin(*dims.SWEPT_TYPES) & (F.col("status") == "active") & (F.lit(as_of).cast("date") > F.date_add(text.first_date(since), F.col("stale_after_days").cast("int")))
    return memories.withColumn("status", F.when(over, "stale").otherwise(F.col("status")))


def drifted(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files (id, content_hash) whose content differs from the index."""
    return files.join(index.select("id", F.col("content_hash").alias("old_hash")), "id").where("old_hash <> content_hash")


def reindexed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Counts of indexed files, drifted files and index rows without a file."""
    both = files.select("id", F.col("content_hash").alias("new_hash")).join(index.select("id", F.col("content_hash").alias("old_hash")), "id", "full_outer")
    return both.agg(
        F.count_if(F.col("new_hash").isNotNull()).alias("indexed"),
        F.count_if(F.col("new_hash") != F.col("old_hash")).alias("drifted"),
        F.count_if(F.col("new_hash").isNull()).alias("orphaned"),
    )


def upserted(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with new and changed rows; access figures of known rows stay."""
    keep = ("access_count", "last_accessed_at")
    new = rows.select("id", *(F.col(c).alias(f"n_{c}") for c in rows.columns if c != "id"), F.lit(True).alias("n_here"))
    out = index.join(new, "id", "full_outer")
    value = lambda c: F.col(c) if f"n_{c}" not in new.columns else (F.coalesce(c, f"n_{c}") if c in keep else F.when(F.col("n_here"), F.col(f"n_{c}")).otherwise(F.col(c)))
    return out.select("id", *(value(c).alias(c) for c in index.columns if c != "id"))


def confirmed(memories: DataFrame, ids: list[str], as_of: str) -> DataFrame:
    """Memories that were confirmed: active again, one confirmation more."""
    hit = F.col("id").isin(ids)
    return memories.withColumn("confirmation_count", F.col("confirmation_count") + hit.cast("int")).withColumn("last_confirmed_at", F.when(hit, F.lit(as_of)).otherwise(F.col("last_confirmed_at"))).withColumn("status", F.when(hit, "active").otherwise(F.col("status")))


def touched(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Access counts and last access from a log (id, at) of hits, which is appended to rather than updated in place."""
    return memories.join(log.groupBy("id").agg(F.count("*").alias("hits"), F.max("at").alias("last")), "id", "left").select(*memories.columns, F.coalesce("hits", F.lit(0)).alias("access_count"), F.col("last").alias("last_accessed_at"))


def accessed(memories: DataFrame, hits: DataFrame, as_of: str) -> DataFrame:
    """Memories after each of ``hits`` (id) was returned once more; access figures that are missing count as none."""
    have = memories.columns
    count = F.coalesce(F.col("access_count") if "access_count" in have else F.lit(None), F.lit(0)).cast("bigint")
    last = F.col("last_accessed_at") if "last_accessed_at" in have else F.lit(None).cast("string")
    hit = F.col("_hit").isNotNull()
    out = memories.join(hits.distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return out.withColumns({"access_count": count + hit.cast("bigint"), "last_accessed_at": F.when(hit, F.lit(as_of)).otherwise(last)}).drop("_hit")


def maintained(memories: DataFrame, as_of: str) -> DataFrame:
    return staled(expired(memories, as_of), as_of)
